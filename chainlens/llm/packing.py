"""Packing by Karmarkar-Karp multiway differencing.

Documents are cut into full windows and a rest; rests are cut further into
parts of at most ``PART`` tokens, so that every window gets several parts.
Parts are gathered in groups of bounded size as a partition streams by; a
group of total T is dealt over ceil(T / window) windows.  Differencing
starts with one partial partition per part (all windows but one empty) and
merges, again and again, the two with the largest imbalance, the heaviest
windows of one with the lightest of the other, until one partition is
left.  If its heaviest window exceeds the capacity, the window count rises
by one and the group is dealt again.

One pass and no shuffle: a group lives in its task, so memory is one
group's parts however large the corpus or a document.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, record, texts_of
from chainlens.llm.token_ids import encoder

WINDOW = 1024
#: Tokens of a part of a rest at most, and tokens of a group of parts at least.
PART, GROUP_TOKENS = 256, 48 * WINDOW


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in ``k`` sets of near-equal sums.

    A partial partition lists its windows that hold something, (sum, indexes)
    in falling order; the others of its k windows are empty."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, w1 = heapq.heappop(heap)
        _, _, w2 = heapq.heappop(heap)
        # heaviest with lightest: window i of one meets window k - 1 - i of the other, often an empty one
        lone1, lone2 = max(0, k - len(w2)), max(0, k - len(w1))
        merged = w1[:lone1] + w2[:lone2]
        merged += [(a + b, g + h) for (a, g), (b, h) in zip(w1[lone1:], reversed(w2[lone2:]))]
        merged.sort(key=itemgetter(0), reverse=True)
        imbalance = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-imbalance, count, merged))
        count += 1
    sets = [g for _, g in heap[0][2]] if heap else []
    return sets + [[] for _ in range(k - len(sets))]


def windows_of(sizes: list[int], window: int) -> list[list[int]]:
    """Sets of indexes whose sizes fit the window: the fewest that differencing fits."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        sets = differencing(sizes, k)
        if max(sum(sizes[i] for i in s) for s in sets) <= window:
            return [s for s in sets if s]
        k += 1


def cuts(n: int, window: int, part: int) -> list[tuple[int, int]]:
    """(start, length) of full windows, then of the rest's parts, near-equal in length."""
    full = [(a, window) for a in range(0, n - window + 1, window)]
    at, rest = len(full) * window, n % window
    pieces = -(-rest // part)
    for i in range(pieces):
        size = rest // pieces + (i < rest % pieces)
        full.append((at, size))
        at += size
    return full


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, part: int = PART, group_tokens: int = GROUP_TOKENS,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, unless switched off, ids (unsigned 32-bit bytes).

    Every id of every text (and its end id) lies in one piece; pieces of a
    sequence follow each other without a gap from offset 0 and fill at most
    ``window``.  Null and empty texts are the end id alone; null and
    repeated ids are documents like any other; parts of equal size are
    dealt in the order they come; very long texts are cut, never
    shortened; other columns, whatever their names, play no part; an empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), *T._parse_datatype_string(
        "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []

    def per_partition(batches: Batches) -> Batches:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        total = 0
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), *((f.name, pa.int64()) for f in fields[1:7])] + [("ids", pa.binary())] * with_ids)
            rows: list[tuple] = []

            def deal(parts: list[tuple]) -> None:
                nonlocal number
                for s in windows_of([p[2] for p in parts], window):
                    at = 0
                    for i in s:
                        rows.append((*parts[i][:5], number, at, *parts[i][5:]))
                        at += parts[i][2]
                    number += 1

            for d, t in zip(b.column(0).to_pylist(), texts_of(b)):
                ids = enc.encode(t) + end
                n = len(ids) // 4
                for start, size in cuts(n, window, part):
                    x = ids[4 * start:4 * (start + size)]
                    piece = (d, start, size, zlib.crc32(x), n, *((x,) if with_ids else ()))
                    if size == window:
                        deal([piece])
                        continue
                    held.append(piece)
                    total += size
                    if total >= group_tokens:
                        deal(held)
                        held, total = [], 0
            if rows:
                yield record(schema, zip(*rows))
        if held:
            rows = []
            deal(held)
            yield record(schema, zip(*rows))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(per_partition, T.StructType(fields))
