"""Spelling variants by PartEnum signatures.

Words are maximal runs of Latin letters.  A word is seen as the binary
vector of its letter multiset (one dimension per letter and occurrence): an
inserted or deleted letter changes one dimension, a replaced one two.
PartEnum deals the dimensions over ``GROUPS`` groups (letters, by falling
frequency, back and forth) and enumerates the vector with every choice of
groups left out:

* words of one length differ by two dimensions at most, which lie in two
  groups at most: one signature per pair of groups left out;
* words whose lengths differ by one differ by one dimension: one signature
  per group left out, under the longer word's length.

So near words share a signature for certain.  One edit also leaves one half
of the word as it is, so each signature is joined once with the first and
once with the second half: still exact, and anagrams no longer meet.  Equal
keys are joined and the edit distance verifies each candidate inside the
join, so what leaves it are near words only.

A word's form is its near word of most occurrences, if these are ``ratio``
times its own.  Counts rise along a chain of forms by that factor, so chains
are short; pointer doubling over the words that have a form finds each
chain's last word in a few joins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import Batches, record, stage, texts_of

#: Groups that PartEnum deals the letters over.
GROUPS = 4
#: Distinct runs and their code points that a task counts before it hands its counts on.
HELD_RUNS, HELD_CHARS = 400_000, 16_000_000
#: Runs up to this many bytes share one table of shifted checksums.
SHORT = 64
_ZERO_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def shifted(crc: np.ndarray, most: int) -> np.ndarray:
    """Row per checksum, column per length 0..most: the part that a prefix of
    this CRC-32 has in the CRC-32 of prefix + text, by the text's bytes.
    CRC-32 is linear, so crc(prefix + text) = shifted(prefix)[bytes] ^ crc(text)."""
    out = np.empty((len(crc), most + 1), np.uint32)
    x = crc.astype(np.uint32)
    for k in range(most + 1):
        out[:, k] = x
        x = _ZERO_STEP[x & 255] ^ (x >> np.uint32(8))
    return out


class Runs(dict):
    """run -> number, with each run's checksum and lengths."""

    def __init__(self):
        super().__init__()
        self.crc, self.n_bytes, self.chars = [], [], 0

    def __missing__(self, run: str) -> int:
        raw = run.encode()
        self[run] = k = len(self.crc)
        self.crc.append(zlib.crc32(raw))
        self.n_bytes.append(len(raw))
        self.chars += len(run)
        return k


def count_runs(docs: DataFrame, min_chars: int, typo_every: int | None, id_col: str, text_col: str) -> DataFrame:
    """(word, n) partial counts of the runs with at least ``min_chars`` code points."""
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % max(1, min_chars))

    def per_batch(batches: Batches) -> Batches:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        runs, total, changed = Runs(), np.zeros(0, np.int64), Counter()

        def flush() -> pa.RecordBatch:
            out = Counter(changed)
            for w, n in zip(runs, total.tolist()):
                if n:
                    out[w] += n
            return record(schema, (list(out), list(out.values())))

        def add(found: list[list[str]], ids: list) -> None:
            nonlocal total
            flat = [w for words in found for w in words]
            if not flat:
                return
            at = np.array([runs[w] for w in flat], np.int64)
            keep = np.ones(len(at), bool)
            if typo_every:
                doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
                prefix = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids]
                size = np.array(runs.n_bytes, np.int64)[at]
                h = shifted(np.array(prefix, np.uint32), SHORT)[doc, np.minimum(size, SHORT)] ^ np.array(runs.crc, np.uint32)[at]
                for i in np.flatnonzero(size > SHORT).tolist():
                    h[i] = zlib.crc32(flat[i].encode(), prefix[doc[i]])
                keep = h % np.uint32(typo_every) != 0
                for i in np.flatnonzero(~keep).tolist():
                    w, cut = flat[i], int(h[i]) % len(flat[i])
                    if len(w) > min_chars:
                        changed[w[:cut] + w[cut + 1:]] += 1
            n = np.bincount(at[keep], minlength=len(runs))
            n[: len(total)] += total
            total = n

        for b in batches:
            ids, held, held_ids, size = b.column(0).to_pylist(), [], [], 0
            for d, t in zip(ids, texts_of(b)):
                held.append(pattern.findall(t.encode().lower().decode()))  # bytes lower-case A to Z alone
                held_ids.append(d)
                size += len(held[-1])
                if size >= 100_000:
                    add(held, held_ids)
                    held, held_ids, size = [], [], 0
                    if len(runs) + len(changed) > HELD_RUNS or runs.chars > HELD_CHARS:
                        yield flush()
                        runs, total, changed = Runs(), np.zeros(0, np.int64), Counter()
            add(held, held_ids)
        yield flush()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(per_batch, "word string, n long")


def letter_groups(words: DataFrame) -> list[str]:
    """The letters of each group; the alphabet bounds what reaches the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''")
    ranked = [r.c for r in letters.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").collect()]
    out = [""] * GROUPS
    for i, c in enumerate(ranked):
        at = i % (2 * GROUPS)
        out[at if at < GROUPS else 2 * GROUPS - 1 - at] += c
    return out


def _left_out(prefix: str, n: int) -> list[tuple[str, tuple[int, ...]]]:
    return [(f"{prefix}{''.join(map(str, d))}", tuple(k for k in range(GROUPS) if k not in d)) for d in combinations(range(GROUPS), n)]


def signatures(words: DataFrame, groups: list[str]) -> DataFrame:
    """(key, grow, word, n): a row per signature and half.  ``grow`` is 0
    where words of one length are compared, 1 for the shorter and 2 for the
    longer word where lengths differ by one."""
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    others = ["".join(g for j, g in enumerate(groups) if j != k) for k in range(GROUPS)]
    parts = words.withColumn("letters", ordered).select(
        "word", "n", F.char_length("word").alias("size"),
        *[F.xxhash64(F.translate("letters", o, "") if o else F.col("letters")).alias(f"g{k}") for k, o in enumerate(others)])

    def halves(shorter: Column) -> list[Column]:
        """First and second half of the shorter word's length, as they lie in this word."""
        first = F.floor(shorter / 2).cast("int")
        return [F.substring("word", F.lit(1), first), F.substring("word", F.col("size") - (shorter - first) + 1, shorter - first)]

    rows = []
    for grow, n, shorter in ((0, 2, F.col("size")), (1, 1, F.col("size")), (2, 1, F.col("size") - 1)):
        for name, kept in _left_out("swap" if grow == 0 else "grow", n):
            for side, half in zip("12", halves(shorter)):
                key = F.xxhash64(F.lit(name + side), shorter, half, *[F.col(f"g{k}") for k in kept])
                rows.append(F.struct(key.alias("key"), F.lit(grow).cast("byte").alias("grow")))
    return parts.select("word", "n", F.explode(F.array(*rows)).alias("s")).select("s.key", "s.grow", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart, once."""
    rows = signatures(words, letter_groups(words))
    a, b = (rows.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("grow", "word", "n")]) for side in "ab")
    same = (F.col("a_grow") == 0) & (F.col("b_grow") == 0) & (F.col("a_word") < F.col("b_word"))
    longer = (F.col("a_grow") == 1) & (F.col("b_grow") == 2)
    found = a.join(b, "key").filter((same | longer) & (F.levenshtein("a_word", "b_word", 1) == 1))
    return found.groupBy("a_word", "b_word").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def chain_ends(forms: DataFrame, name: str = "variant-roots") -> DataFrame:
    """(word, root) of the rows (word, form): pointer doubling until no pointer moves."""
    ends = stage(forms.select("word", F.col("form").alias("root")), name)
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                          F.col("further").isNotNull().alias("moved")), name)
        ends = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return ends


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: float = 2, typo_every: int | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word, form, root, n, n_near and form_n of every word of the corpus.

    Words are runs of Latin letters with A to Z lower-cased, of at least
    ``min_chars`` code points and ``min_count`` occurrences in all.  Ties of
    forms go to the smallest in code-point order.  With ``typo_every``, an
    occurrence whose checksum with its document's id that number divides
    loses one letter before it is counted.

    Null and empty texts have no words; a null id counts as empty text in
    the checksum; repeated rows and ids count each; very long texts and runs
    are counted whole; other columns, whatever their names, play no part; a
    table without words gives an empty result.
    """
    counts = count_runs(docs, min_chars, typo_every, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))
    words = stage(counts.filter(F.col("n") >= min_count), "variant-words")
    pairs = stage(near_pairs(words), "variant-pairs")
    sides = F.array(F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("other"), F.col("b_n").alias("other_n")),
                    F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("other"), F.col("a_n").alias("other_n")))
    # most occurrences first, then the smallest word
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    per_word = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    judged = stage(words.join(per_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")), "variant-forms")
    roots = chain_ends(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
