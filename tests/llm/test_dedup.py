"""Line dedup, exact dedup and SimHash against brute force."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chainlens.llm import exact_dedup, line_dedup, simhash
from chainlens.llm.common import fresh_path


def test_perfect_hash_is_minimal_and_rejects_foreign():
    r = np.random.default_rng(0)
    h, fp = (np.unique(r.integers(0, 2 ** 63, 6000, dtype=np.uint64))[:5000] for _ in range(2))
    h[10], h[11] = h[12], h[12]  # equal slot hashes with other fingerprints
    n = r.integers(2, 300, 5000)
    s = line_dedup.Shard.load(line_dedup.Shard.build(h, fp, n).dump())
    assert len(s.fps) == 5000 and (s.counts_of(h, fp) == n).all()
    assert (s.counts_of(h, fp + np.uint64(1)) == 0).all() and (s.counts_of(h + np.uint64(1), fp) == 0).all()
    none = line_dedup.Shard.build(h[:0], fp[:0], n[:0])
    assert (none.counts_of(h, fp) == 0).all()


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= least)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(nasty, empty, docs):
    for rows, least in ((nasty, 10), (nasty, 1), (docs, 3)):
        got = line_dedup.dedup_lines(rows, min_docs=least, shard_entries=50).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_lines([(r.doc_id, r.text) for r in rows.collect()], least)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_index_opens_each_shard_once(spark):
    """Many shards, many batches: within its bytes a worker loads each shard once, beyond them it still finds all."""
    r = np.random.default_rng(0)
    h, fp = (np.unique(r.integers(0, 2 ** 62, 9000, dtype=np.int64))[:8000] for _ in range(2))
    r.shuffle(fp)
    counts = spark.createDataFrame([(int(a), int(b), 10 + i % 7) for i, (a, b) in enumerate(zip(h, fp))] + [(int(a) + 1, 5, 9) for a in h[:500]],
                                   "h long, fp long, n long")
    path, n = line_dedup.build_index(counts, 10, 100)
    assert n == 80
    for cached, loads in ((1 << 28, n), (1, 10 * n)):
        index = line_dedup.Index(path, n, cached)
        for _ in range(10):
            assert (index.counts_of(h.view(np.uint64), fp.view(np.uint64)) == 10 + np.arange(8000) % 7).all()
        assert index.loads == loads
    assert (index.counts_of((h[:500] + 1).view(np.uint64), np.full(500, 5, np.uint64)) == 0).all()  # below the limit: not indexed


def test_exact_dedup_takes_a_path_with_a_slash(spark, docs):
    path = fresh_path(spark, "in")
    docs.write.parquet(path)
    assert exact_dedup.dedup_path(spark, path + "/", docs.schema).count() == docs.count()


def test_exact_dedup(spark, nasty, empty, docs):
    def weak(text):  # collides all the time, so that full bytes decide
        return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(7)).cast("string")

    for rows in (nasty, docs, empty):
        path = fresh_path(spark, "in")
        rows.write.parquet(path)
        groups = defaultdict(list)
        for r in rows.collect():
            groups[r.text or ""].append(r.doc_id)
        want = Counter()
        for ids in groups.values():
            top = max((i for i in ids if i is not None), default=None)
            for i in ids:
                want[(i, top, len(ids))] += 1
        for digest in (exact_dedup.sha256, weak):
            got = exact_dedup.dedup_path(spark, path, rows.schema, digest=digest).collect()
            assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
            assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
        kept = exact_dedup.drop_copies(rows)
        assert kept.columns == rows.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)


def test_dedup_state_outlives_the_stream(spark, docs):
    path, state = fresh_path(spark, "in"), fresh_path(spark, "state")
    docs.filter("doc_id % 2 = 0").write.parquet(path)
    first = exact_dedup.run_stream(spark, path, docs.schema, state).agg(F.sum("n")).first()[0]
    docs.filter("doc_id % 2 = 1").write.mode("append").parquet(path)
    both = exact_dedup.run_stream(spark, path, docs.schema, state)
    assert (first, both.agg(F.sum("n")).first()[0]) == (docs.filter("doc_id % 2 = 0").count(), docs.count())
    top = docs.groupBy(exact_dedup.sha256(F.col("text")).alias("digest")).agg(F.max("doc_id").alias("m"), F.count("*").alias("k"))
    assert both.join(top, "digest").filter("best.doc_id = m AND n = k").count() == top.count() == both.count()


def brute_fingerprint(text, k):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, radius):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_covering_masks_hide_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_have_the_components_of_all_pairs(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 2 ** 63, 20, dtype=np.uint64)]
    fps = set(base)
    for b in base[:6]:  # crowds around a point and chains away from it
        x = b
        for _ in range(60):
            flip = [1 << int(i) for i in r.integers(0, 64, 2)]
            fps.add(b ^ flip[0] ^ flip[1])
            x ^= flip[0] | flip[1]
            fps.add(x)
    for radius in (1, 2):
        want = brute_components(fps, radius)
        for limit in (1, 5, 1000):
            df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
            got = {r.node: r.root for r in simhash.components(simhash.links(df, radius, limit)).collect()}
            classes = defaultdict(set)
            for f in fps:
                classes[got.get(simhash.signed(f), simhash.signed(f))].add(f)
            other = defaultdict(set)
            for f, c in want.items():
                other[c].add(f)
            assert sorted(map(sorted, classes.values())) == sorted(map(sorted, other.values()))


def test_simhash(nasty, empty, docs):
    for rows in (nasty, docs):
        data = [(r.doc_id, brute_fingerprint(r.text, 3)) for r in rows.collect()]
        comp = brute_components([f for _, f in data], 2)
        least = {}
        for d, f in data:
            if d is not None:
                least[comp[f]] = min(d, least.get(comp[f], d))
        got = simhash.near_duplicates(rows, shingle_words=3, radius=2).collect()
        assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == Counter((d, simhash.signed(f), least.get(comp[f])) for d, f in data)
        kept = simhash.keep_one(rows)
        assert kept.columns == rows.columns
        assert {r.doc_id for r in kept.collect()} == {None for d, _ in data if d is None} | set(least.values())
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()
