"""Token files: static range asymmetric numeral system (rANS).

Layout of a token file (a folder):

* ``freqs``: the frequency table that all blocks share, (id, freq); the
  freqs sum to 2^SCALE.
* ``blocks``: one row per block, with ``shard`` (range of ascending
  documents), ``block`` (number in the shard), ``base`` (tokens of the
  shard before it), ``n_tokens``, the documents it holds (``doc_ids``,
  ``lengths``) and ``payload``.  Blocks hold whole documents and are coded
  independently of each other, so any reader takes any rows.

A payload codes its ids over ``LANES`` interleaved 64-bit states that emit
32-bit words; every ``STRIDE`` steps a checkpoint keeps the states and the
word position, so that a segment can be decoded without the ones before
it; each segment has the CRC-32 of its ids and the payload one of its own.

Writing: whole texts are encoded once and staged as ids; one aggregate
counts ids (at most the vocabulary in rows), documents are range-partitioned
and sorted by id, and each partition writes its blocks as they fill.  Rows
reach the workers a thousand at a time, and ranges that are more than the
shards asked for share the files of the blocks.
Reading: blocks are decoded where they lie; a document's place among all
ids is its shard's base (a running sum over one row per shard) plus its
place in the shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, record, settings, stage, texts_of
from chainlens.llm.token_ids import encoder

SCALE, LANES, STRIDE = 20, 2048, 128
#: Ids of a block, or one document's if it has more.
BLOCK_TOKENS = 1 << 19
#: Whole texts are large rows, so few of them are read or sent at once.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.parquet.columnarReaderBatchSize": "1024"}
MAGIC = b"RNS1"
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIIIII")  # magic, lanes, stride, tokens, segments, words, crc of all that follows


def shared_table(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, freqs): counts scaled to a sum of 2^SCALE, at least 1 each."""
    ids = np.array(sorted(counts), np.int64)
    n = np.array([counts[i] for i in ids.tolist()], np.float64)
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    freqs = np.maximum(1, np.floor(n / n.sum() * (1 << SCALE))).astype(np.int64)
    # the difference goes to the most frequent ids, which it changes least
    order, gap = np.argsort(-n, kind="stable"), (1 << SCALE) - int(freqs.sum())
    k = 0
    while gap:
        i = order[k % len(order)]
        change = gap if gap > 0 else max(gap, 1 - int(freqs[i]), -int(freqs[i]) // 2)
        freqs[i] += change
        gap -= change
        k += 1
    return ids, freqs


class Coder:
    """Codes arrays of ids with one frequency table."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64) if len(ids) else self.freqs
        self.slots = np.repeat(np.arange(len(ids), dtype=np.uint32), freqs)
        self.place = np.zeros(int(ids.max(initial=-1)) + 1, np.uint32)
        self.place[ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> bytes:
        """A payload; ids beyond the table raise."""
        n = len(ids)
        if n and (ids.max() >= len(self.place) or (self.ids[self.place[ids]] != ids).any()):
            raise ValueError("an id is not in the shared table")
        s = self.place[ids] if n else np.zeros(0, np.uint32)
        f, c = self.freqs[s], self.starts[s]
        most = f << np.uint64(63 - SCALE)
        x = np.full(LANES, LOW, np.uint64)
        steps = -(-n // LANES)
        words: list[np.ndarray] = []
        marks: list[tuple[np.ndarray, int]] = []
        for t in range(steps - 1, -1, -1):
            a, b = t * LANES, min(n, (t + 1) * LANES)
            y, ft = x[: b - a], f[a:b]
            full = y >= most[a:b]
            words.append(y[full].astype(np.uint32))
            y = np.where(full, y >> np.uint64(32), y)
            q = y // ft
            x[: b - a] = (q << np.uint64(SCALE)) + (y - q * ft) + c[a:b]
            if t % STRIDE == 0:
                marks.append((x.copy(), len(words)))
        words.reverse()
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
        span = STRIDE * LANES
        body = b"".join(struct.pack("<II", int(at[len(words) - k]), zlib.crc32(ids[j * span:(j + 1) * span].astype("<u4").tobytes()))
                        + states.astype("<u8").tobytes() for j, (states, k) in enumerate(reversed(marks)))
        body += stream.astype("<u4").tobytes()
        return HEAD.pack(MAGIC, LANES, STRIDE, n, len(marks), len(stream), zlib.crc32(body)) + body

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the segments ``first`` to ``last`` (all by default), decoded
        side by side from their checkpoints; a damaged payload raises."""
        magic, lanes, stride, n, segments, n_words, crc = HEAD.unpack_from(payload)
        body = memoryview(payload)[HEAD.size:]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged token block")
        last = segments if last is None else min(last, segments)
        mark, span = 8 + 8 * lanes, lanes * stride
        stream = np.frombuffer(body, "<u4", n_words, segments * mark).astype(np.uint64)
        parts = []
        for j in range(first, last):
            at, want = struct.unpack_from("<II", body, j * mark)
            x = np.frombuffer(body, "<u8", lanes, j * mark + 8).astype(np.uint64)
            m = min(span, n - j * span)
            out = np.empty(m, np.uint32)
            for a in range(0, m, lanes):
                b = min(m, a + lanes)
                y = x[: b - a]
                slot = y & np.uint64((1 << SCALE) - 1)
                s = self.slots[slot]
                out[a:b] = self.ids[s]
                y = self.freqs[s] * (y >> np.uint64(SCALE)) + slot - self.starts[s]
                low = np.flatnonzero(y < LOW)
                y[low] = (y[low] << np.uint64(32)) | stream[at:at + len(low)]
                at += len(low)
                x[: b - a] = y
            if zlib.crc32(out.astype("<u4").tobytes()) != want:
                raise ValueError("damaged token block segment")
            parts.append(out)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids): ids of the whole text and the end id, as unsigned bytes of
    the vocabulary's width (``id_width``)."""
    def per_batch(batches: Batches) -> Batches:
        enc, end, width = encoder(tokenizer), struct.pack("<I", end_id), id_width(tokenizer, end_id)
        for b in batches:
            ids = [np.frombuffer(enc.encode(t) + end, "<u4").astype(width).tobytes() for t in texts_of(b)]
            yield record(pa.schema([("doc_id", b.column(0).type), ("ids", pa.binary())]), (b.column(0), ids))

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(per_batch, out)


def id_width(tokenizer: str, end_id: int) -> str:
    return "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, width: str) -> dict[int, int]:
    """Occurrences of every id: at most the vocabulary in rows."""
    def per_batch(batches: Batches) -> Batches:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width), minlength=len(total))
            n[: len(total)] += total
            total = n
        ids = np.flatnonzero(total)
        yield record(pa.schema([("id", pa.int64()), ("n", pa.int64())]), (ids, total[ids]))

    found = tokens.select("ids").mapInArrow(per_batch, "id long, n long")
    return {r.id: r.n for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          block_tokens: int = BLOCK_TOKENS, shard_tokens: int = 16 * BLOCK_TOKENS) -> None:
    """Write the token file of ``docs`` to the folder ``path``, in ascending id order.

    Null texts are empty (the end id alone); null ids come first; rows that
    repeat an id stay, ordered by their ids' bytes; an empty table gives a
    file without blocks.
    """
    with settings(docs.sparkSession, FEW_ROWS):
        _write(docs, path, tokenizer, end_id, id_col, text_col, block_tokens, shard_tokens)


def _write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str, text_col: str, block_tokens: int, shard_tokens: int) -> None:
    spark = docs.sparkSession
    tokens = stage(tokenized(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    width = id_width(tokenizer, end_id)
    size = np.dtype(width).itemsize
    counts = id_counts(tokens, width)
    ids, freqs = shared_table(counts)
    if len(ids) > 1 << SCALE:
        raise ValueError("more ids than the frequency table has slots")
    table = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freqs)], "id int, freq int")
    table.coalesce(1).write.parquet(f"{path}/freqs")
    shards = max(1, -(-sum(counts.values()) // shard_tokens))
    kind = tokens.schema["doc_id"].dataType
    block = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("base", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])

    def blocks(batches: Batches) -> Batches:
        coder, state = Coder(ids, freqs), {"block": 0, "base": 0}

        def emit(held: list, arrow_id: pa.DataType) -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(x for _, x in held), width)
            schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_tokens", pa.int64()),
                                ("doc_ids", pa.list_(arrow_id)), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
            out = record(schema, ([state["shard"]], [state["block"]], [state["base"]], [len(flat)], [[d for d, _ in held]],
                                  [[len(x) // size for _, x in held]], [coder.encode(flat)]))
            state["block"] += 1
            state["base"] += len(flat)
            return out

        held, n, arrow_id = [], 0, None
        for b in batches:
            arrow_id = b.column(0).type
            if b.num_rows:
                state["shard"] = b.column(2)[0].as_py()
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and n + len(x) // size > block_tokens:
                    yield emit(held, arrow_id)
                    held, n = [], 0
                held.append((d, x))
                n += len(x) // size
        if held:
            yield emit(held, arrow_id)

    # rows that share an id differ in the second key, so one id cannot fill a shard;
    # each range is a shard of its own in whichever task it is written
    (tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "h")
     .sortWithinPartitions("doc_id", "ids").select("doc_id", "ids", F.spark_partition_id().alias("shard"))
     .mapInArrow(blocks, block).coalesce(max(shards, spark.sparkContext.defaultParallelism)).write.parquet(f"{path}/blocks"))


def open_coder(spark: SparkSession, path: str) -> Coder:
    rows = spark.read.parquet(f"{path}/freqs").orderBy("id").collect()  # at most the vocabulary
    return Coder(np.array([r.id for r in rows], np.int64), np.array([r.freq for r in rows], np.int64))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids_crc32 and, unless switched off, ids (array)."""
    table = open_coder(spark, path)
    ids, freqs = table.ids.astype(np.int64), table.freqs.astype(np.int64)
    stored = spark.read.parquet(f"{path}/blocks")
    kind = stored.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("doc_id", kind),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []

    def per_batch(batches: Batches) -> Batches:
        coder = Coder(ids, freqs)
        for b in batches:
            for shard, base, doc_ids, lengths, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "base", "doc_ids", "lengths", "payload"))):
                flat = coder.decode(payload).astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                cut = [flat[e - n:e] for e, n in zip(ends.tolist(), lengths)]
                cols = [[shard] * len(cut), base + ends - np.array(lengths), pa.array(doc_ids, b.schema.field("doc_ids").type.value_type),
                        lengths, [zlib.crc32(x.tobytes()) for x in cut]] + ([[x.tolist() for x in cut]] if with_ids else [])
                types = [pa.int32(), pa.int64(), cols[2].type, pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
                yield record(pa.schema([(f.name, t) for f, t in zip(fields, types, strict=True)]), cols)

    found = stored.select("shard", "base", "doc_ids", "lengths", "payload").mapInArrow(per_batch, T.StructType(fields))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
              .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start")))  # one row per shard
    return found.join(F.broadcast(starts), "shard").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32",
                                              *(["ids"] if with_ids else []))
