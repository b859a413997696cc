"""Token files and packing against direct encoding."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainlens.llm import packing, rans_tokens
from chainlens.llm.common import fresh_path, settings
from chainlens.llm.queries import tokenizer_file
from chainlens.llm.token_ids import Encoder

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")


def direct(file, rows, end):
    t = Tokenizer.from_file(file)
    return [(r.doc_id, np.array(t.encode(r.text or "", add_special_tokens=False).ids + [end], "<u4")) for r in rows]


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_encoder_equals_whole_text_encoding(file):
    import random
    r = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "ll", "1", "9x", "!", "_", "...", "ß", "\xa0", " ", "\x1c", "\x1f",
             "́", "İ", "Σ", "日本", "<|endoftext|>", "#", "</w>", "​", "\x85", "😀", "×"]
    e, t = Encoder(file), Tokenizer.from_file(file)
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(e.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, ascii(s)


def test_rans_round_trip_and_segments():
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 300_000):
        ids = np.minimum(r.zipf(1.3, n), 40_000).astype(np.uint32)
        counts = dict(zip(*(x.tolist() for x in np.unique(np.append(ids, 7), return_counts=True))))
        table, freqs = rans_tokens.shared_table(counts)
        assert freqs.sum() == 1 << rans_tokens.SCALE and freqs.min() >= 1
        c = rans_tokens.Coder(table, freqs)
        blob = c.encode(ids)
        assert (c.decode(blob) == ids).all()
        span = rans_tokens.LANES * rans_tokens.STRIDE
        assert (c.decode(blob, 1, 2) == ids[span:2 * span]).all()
        if n > 1000:
            p = np.array(list(counts.values())) / sum(counts.values())
            entropy = -(p * np.log2(p)).sum() * n / 8
            assert len(blob) < 1.02 * entropy + 8 * rans_tokens.LANES * (2 + n // span)
            with pytest.raises(ValueError):
                c.decode(blob[:-9] + bytes([blob[-9] ^ 1]) + blob[-8:])
    with pytest.raises(ValueError):
        c.encode(np.array([41_000], np.uint32))


def test_token_file(spark, nasty, empty, docs):
    for rows in (docs, nasty):
        path = fresh_path(spark, "t")
        rans_tokens.write(rows, path, WORD, end_id=2, block_tokens=3000, shard_tokens=20_000)
        got = rans_tokens.read(spark, path).collect()
        assert spark.read.parquet(path + "/blocks").count() > 3
        want = sorted(direct(WORD, rows.collect(), 2), key=lambda x: (x[0] is not None, x[0] or 0))
        got.sort(key=lambda r: r.start)
        assert [r.doc_id for r in got] == [d for d, _ in want]
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.n_tokens
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(d), tuple(x.tolist())) for d, x in want)
    path = fresh_path(spark, "t")
    rans_tokens.write(empty, path, WORD, end_id=2)
    assert rans_tokens.read(spark, path).count() == 0


def test_token_file_of_many_ranges(spark, docs, monkeypatch):
    """Ranges beyond the shards asked for share files, and documents are not shuffled when read."""
    ranged = type(docs).repartitionByRange
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda self, n, *c: ranged(self, max(n, 40), *c))
    path = fresh_path(spark, "t")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        rans_tokens.write(docs, path, WORD, end_id=2)
        blocks = spark.read.parquet(path + "/blocks")
        assert blocks.select("shard").distinct().count() > 30
        assert blocks.select(F.input_file_name()).distinct().count() <= spark.sparkContext.defaultParallelism
        file = rans_tokens.read(spark, path)
        assert "SortMergeJoin" not in file._jdf.queryExecution().executedPlan().toString()
        got = sorted(file.collect(), key=lambda r: r.start)
    want = sorted(direct(WORD, docs.collect(), 2), key=lambda x: x[0])
    assert [(r.doc_id, r.ids) for r in got] == [(d, x.tolist()) for d, x in want]
    assert [r.start for r in got] == np.cumsum([0] + [len(x) for _, x in want])[:-1].tolist()


def test_differencing_is_near_equal_and_fits():
    import random
    r = random.Random(0)
    sizes = [r.randint(1, 256) for _ in range(400)]
    sets = packing.differencing(sizes, 40)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(400)) and max(sums) - min(sums) <= 4
    assert packing.differencing([5, 4, 3, 2], 2) in ([[0, 3], [1, 2]], [[1, 2], [0, 3]], [[3, 0], [2, 1]], [[2, 1], [3, 0]])
    # four sizes of 6 in windows of 10: two are too few, so the count rises
    assert len(packing.windows_of([6, 6, 6, 6], 10)) == 4 and packing.windows_of([], 10) == []


def test_packing(nasty, empty, docs):
    for rows in (docs, nasty):
        got = packing.pack(rows, BYTE, end_id=0).collect()
        full = direct(BYTE, rows.collect(), 0)
        pieces, seqs = {}, {}
        for p in got:
            assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.length == len(p.ids) // 4 and p.length > 0
            pieces.setdefault(str(p.doc_id), []).append((p.start, bytes(p.ids), p.doc_tokens))
            seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for d in {str(d) for d, _ in full}:
            own = [x.tobytes() for e, x in full if str(e) == d]
            if len(own) == 1:
                cut = sorted(pieces[d])
                assert b"".join(x for _, x, _ in cut) == own[0] and all(n == len(own[0]) // 4 for _, _, n in cut)
                assert [s for s, _, _ in cut] == np.cumsum([0] + [len(x) // 4 for _, x, _ in cut])[:-1].tolist()
            else:
                assert sum(len(x) for _, x, _ in pieces[d]) == sum(map(len, own))
        for s in seqs.values():
            s.sort()
            assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 1024
        total = sum(len(x) for _, x in full)
        assert len(seqs) * 1024 < 1.06 * total + 1024 * 8
    assert packing.pack(empty, BYTE, end_id=0).count() == 0
