"""Line dedup: a sharded minimal perfect hash over repeated line hashes.

Two passes over the documents and no join of lines:

1. Every document emits the 128-bit hash of each of its distinct line keys
   once; Spark counts documents per hash (map-side first, so a line that a
   third of the corpus holds is one row per task).
2. Hashes are split into shards of bounded size by their own bits; each
   shard becomes a minimal perfect hash with two arrays, the fingerprint
   and the document count of the hash in each slot.  Shards are rows of a
   table in the shared folder.
3. Documents probe: a task hashes its lines, opens the shards they fall in
   (a bounded number stays in memory) and drops the lines whose slot holds
   their fingerprint and a count at the limit.

A hash below the limit can never be dropped, so it is left out of the
index; the fingerprint is what tells such a foreign line from the entry
whose slot it lands on.  A shard
takes about ``shard_entries`` x (8 B fingerprint + 1-8 B count + 0.5 B
hash), whatever the corpus holds.
"""

from __future__ import annotations

import io
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, fresh_path, record, stage, texts_of

#: Bits per key of a level of the perfect hash, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 24
#: Bytes of shards that a worker keeps in memory.
CACHED_BYTES = 256 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return line.strip().lower()


def hash_pair(key: bytes) -> tuple[int, int]:
    """Slot hash and fingerprint."""
    return xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1)


def _level_hash(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h + _MIX * np.uint64(level + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class Shard:
    """A minimal perfect hash of its entries with fingerprint and count arrays."""

    def __init__(self, sizes, bits, rest_h, rest_fp, fps, counts):
        self.sizes, self.rest_h, self.rest_fp, self.fps, self.counts = sizes, rest_h, rest_fp, fps, counts
        self.bits = bits
        self.prefix = np.cumsum(bits, dtype=np.int32) - bits  # ones before each bit: the slot

    @classmethod
    def build(cls, h: np.ndarray, fp: np.ndarray, counts: np.ndarray) -> Shard:
        left = np.arange(len(h))
        slot_of = np.full(len(h), -1, np.int64)
        sizes, levels, base = [], [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = int(max(64, GAMMA * len(left)))
            pos = _level_hash(h[left], level, size)
            alone = np.bincount(pos, minlength=size)[pos] == 1
            bits = np.zeros(size, bool)
            bits[pos[alone]] = True
            rank = np.cumsum(bits) - 1
            slot_of[left[alone]] = base + rank[pos[alone]]
            base += int(alone.sum())
            sizes.append(size)
            levels.append(bits)
            left = left[~alone]
        # what no level separates (equal slot hashes with other fingerprints) is listed, sorted
        order = left[np.lexsort((fp[left], h[left]))]
        slot_of[order] = base + np.arange(len(order))
        fps, cnt = np.empty_like(fp), np.empty(len(h), np.min_scalar_type(int(counts.max(initial=0))))
        fps[slot_of], cnt[slot_of] = fp, counts
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), bits, h[order], fp[order], fps, cnt)

    def counts_of(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Document counts, 0 for hashes that are not in the shard."""
        out, todo, offset = np.zeros(len(h), np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                return out
            pos = offset + _level_hash(h[todo], level, size)
            hit = self.bits[pos]
            slot, who = self.prefix[pos[hit]], todo[hit]
            same = self.fps[slot] == fp[who]
            out[who[same]] = self.counts[slot[same]]
            todo, offset = todo[~hit], offset + size
        first = len(self.fps) - len(self.rest_h)
        listed = {(a, b): first + i for i, (a, b) in enumerate(zip(self.rest_h.tolist(), self.rest_fp.tolist()))}
        for i in todo.tolist() if listed else ():
            slot = listed.get((int(h[i]), int(fp[i])))
            if slot is not None:
                out[i] = self.counts[slot]
        return out

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, sizes=self.sizes, bits=np.packbits(self.bits), n=len(self.bits), rest_h=self.rest_h,
                 rest_fp=self.rest_fp, fps=self.fps, counts=self.counts)
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        z = np.load(io.BytesIO(blob))
        return cls(z["sizes"], np.unpackbits(z["bits"], count=int(z["n"])).astype(bool),
                   z["rest_h"], z["rest_fp"], z["fps"], z["counts"])


HASHES = pa.schema([("h", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])


def count_lines(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h, fp, n): documents (rows) that hold each line key of ``min_chars`` code points or more."""
    def emit(batches: Batches) -> Batches:
        for b in batches:
            seen: dict[bytes, int] = {}
            for t in texts_of(b):
                for k in {line_key(x) for x in t.encode().split(b"\n")}:
                    if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars):
                        seen[k] = seen.get(k, 0) + 1
            pairs = np.array([hash_pair(k) for k in seen], np.uint64).reshape(-1, 2).view(np.int64)
            yield record(HASHES, (pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), list(seen.values())))

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(emit, "h long, fp long, n long")
    return found.groupBy("h", "fp").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, least: int, shard_entries: int = 1 << 16) -> tuple[str, int]:
    """Write the shards of all hashes in at least ``least`` documents; (path, number of shards)."""
    spark = counts.sparkSession
    kept = stage(counts.filter(F.col("n") >= least), "line-counts")
    n_shards = max(1, -(-kept.count() // shard_entries))

    def build(pdf):
        s = Shard.build(pdf["h"].to_numpy().view(np.uint64), pdf["fp"].to_numpy().view(np.uint64), pdf["n"].to_numpy())
        return pdf.iloc[:1][["shard"]].assign(blob=[s.dump()])

    path = fresh_path(spark, "line-index")
    (kept.withColumn("shard", F.pmod("h", F.lit(n_shards)))
     .groupBy("shard").applyInPandas(build, "shard long, blob binary")
     .write.partitionBy("shard").parquet(path))
    return path, n_shards


class Index:
    """Shards opened as needed; those used last stay in memory, up to ``cached`` bytes."""

    def __init__(self, path: str, n_shards: int, cached: int = CACHED_BYTES):
        from pyarrow import fs
        self.fs, self.root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
        self.n_shards, self.cached = n_shards, cached
        self.open: OrderedDict[int, tuple[Shard | None, int]] = OrderedDict()
        self.held = self.loads = 0

    def shard(self, k: int) -> Shard | None:
        if k not in self.open:
            from pyarrow import fs
            found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/shard={k}", allow_not_found=True))
            files = [f.path for f in found if f.path.endswith(".parquet")]
            blobs = [x for f in files for x in pq.read_table(self.fs.open_input_file(f), columns=["blob"])["blob"].to_pylist()]
            # the prefix counts of a shard take four bytes per bit of its levels, which a blob packs
            shard = Shard.load(blobs[0]) if blobs else None
            size = len(blobs[0]) + 5 * len(shard.bits) if shard else 0
            self.open[k] = shard, size
            self.held += size
            self.loads += 1
            while self.held > self.cached and len(self.open) > 1:
                self.held -= self.open.popitem(last=False)[1][1]
        self.open.move_to_end(k)
        return self.open[k][0]

    def counts_of(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        which = h.view(np.int64) % self.n_shards  # numpy's % of a positive divisor is Spark's pmod
        order = np.argsort(which, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(h) else ():
            s = self.shard(int(which[part[0]]))
            if s is not None:
                out[part] = s.counts_of(h[part], fp[part])
        return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                min_chars: int = 1, shard_entries: int = 1 << 16) -> DataFrame:
    """Drop every line whose key at least ``min_docs`` documents hold.

    Returns doc_id, n_lines (before), n_dropped, text (the lines that stay,
    joined by a line feed).  Each row is a document of its own, so repeated
    rows and repeated ids count as many documents; a null text is one empty
    line; blank lines have no key and stay; a null id is passed on.  An
    empty table gives an empty result.
    """
    path, n_shards = build_index(count_lines(docs, text_col, min_chars), min_docs, shard_entries)
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_lines", T.LongType()),
                        T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())])

    def probe(batches: Batches) -> Batches:
        index = Index(path, n_shards)
        for b in batches:
            lines = [t.encode().split(b"\n") for t in texts_of(b)]
            number: dict[bytes, int] = {}
            refs = [[number.setdefault(line_key(x), len(number)) for x in ls] for ls in lines]
            pairs = np.array([hash_pair(k) for k in number], np.uint64).reshape(-1, 2)
            drop = index.counts_of(pairs[:, 0].copy(), pairs[:, 1].copy()) >= min_docs
            for k in [i for k, i in number.items() if len(k) < min_chars or min_chars > 1 and len(k.decode()) < min_chars]:
                drop[k] = False
            kept = [[x for x, r in zip(ls, rs) if not drop[r]] for ls, rs in zip(lines, refs)]
            schema = pa.schema([("doc_id", b.column(0).type), ("n_lines", pa.int64()),
                                ("n_dropped", pa.int64()), ("text", pa.string())])
            yield record(schema, (b.column(0), [len(x) for x in lines],
                                  [len(x) - len(y) for x, y in zip(lines, kept)],
                                  [b"\n".join(x).decode() for x in kept]))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(probe, out)
