"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits; documents within ``radius`` bits of each other
are linked, and linked documents form components.

Covering masks: every bit position i gets one of the 2^(radius+1) - 1
nonzero vectors m(i) of radius + 1 bits, in turn; table v (each nonzero
vector again) keeps the bits with <m(i), v> = 1 mod 2.  For any set of at
most ``radius`` differing bits there is a v orthogonal to all their
vectors, so that table's mask hides every difference and the pair shares
its key: no pair within the radius is missed, whatever the data.

Documents are first grouped by fingerprint, so copies cost one row.  In a
table's bucket of up to ``pair_limit`` fingerprints the pairs are compared
directly.  Larger buckets are never paired: for radius 2 two fingerprints
are linked exactly if they share a point one flip (or none) away from
both, so each member emits itself and its single flips of the bits the
mask hides, and all members at one point are linked to the smallest one.
That is linear in the bucket and exact, with no cap.

Components come from alternating large-star and small-star rounds over
the links of distinct fingerprints; every round is written to the shared
folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, record, signed, stage, texts_of

BITS = 64
#: Fingerprints of a bucket that are compared pairwise at most.
PAIR_LIMIT = 24


def shingles(text: str, k: int) -> list[bytes]:
    """Space-joined runs of k words (A-Z lower-cased), repeats included; all
    words as one if there are fewer, none without a word."""
    words = text.encode().lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    flat = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [flat[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())]


def fingerprint(text: str, k: int = 3) -> int:
    """Bit b is set if over half of the shingles' XXH64 (seed 42) have it; 0 without a word."""
    grams = shingles(text, k)
    if not grams:
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(grams), 1 << 16):  # bounded memory for very long texts
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams[i:i + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(grams)).tolist()))


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; any ``radius`` bits are all hidden by one of them."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``."""
    def per_batch(batches: Batches) -> Batches:
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), ("fp", pa.int64())])
            yield record(schema, (b.column(0), [signed(fingerprint(t, k)) for t in texts_of(b)]))

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(per_batch, out)


def near(a, b, radius: int):
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(fps: DataFrame, radius: int, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) with a < b: links between the distinct fingerprints ``fps`` (column fp)
    that have the same components as all pairs within ``radius``."""
    if radius > 2:
        raise ValueError("crowded buckets are split exactly for a radius of up to 2")
    masks = covering_masks(radius)
    table = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks))))
    rows = (fps.select("fp", table.alias("x"))
            .select("fp", F.col("x.t").alias("t"), F.col("x.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key")))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = stage(rows.join(sizes, ["t", "key"]), "simhash-buckets")
    few, many = rows.filter(F.col("n") <= pair_limit), rows.filter(F.col("n") > pair_limit)
    a, b = (few.select("t", "key", F.col("fp").alias(c)) for c in "ab")
    pairs = a.join(b, ["t", "key"]).filter(F.col("a") < F.col("b")).filter(near(F.col("a"), F.col("b"), radius)).select("a", "b")
    # a point that is one hidden bit (radius 2) or none (radius 1: the pair differs by one flip) away
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS)))
    hidden = F.filter(flips, lambda f: f.bitwiseAND(F.col("mask")) == 0)
    points = many.select("fp", "t", F.explode(hidden).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "flip")
    if radius < 2:
        # one flip apart: the larger's flip is the smaller itself
        stars = (points.alias("p").join(many.select(F.col("fp").alias("q")).distinct(), F.col("p.point") == F.col("q"))
                 .select(F.least("p.fp", "q").alias("a"), F.greatest("p.fp", "q").alias("b")))
    else:
        hubs = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").select("point", "a")
        stars = points.join(hubs, "point").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).filter("a < b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of ``edges`` (a, b)."""
    e = stage(edges.filter("a <> b").select("a", "b"), "links")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours hang on the smallest node around
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = stage(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
                    .select(F.col("b").alias("a"), F.col("a").alias("b")), "links")
        # a forest of stars: no root hangs on another node, no node on two roots
        roots, leaves = nxt.select(F.col("a").alias("b")).distinct(), nxt.groupBy("b").agg(F.count("*").alias("n"))
        e = nxt
        if not leaves.join(roots.withColumn("root", F.lit(1)), "b", "left").filter("n > 1 OR root = 1").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    radius: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, itself included.  Null and empty texts have
    fingerprint 0 and link like any other; null ids take part but never
    name a component unless all its ids are null; repeated rows stay.
    """
    prints = stage(with_fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), radius, pair_limit))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    comp = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(comp, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each component: the one that names it.
    Rows with a null id stay."""
    n = near_duplicates(docs, id_col, **how)
    drop = n.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs[id_col] == F.col("__drop"), "left_anti")
