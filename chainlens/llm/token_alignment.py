"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers' tokens of a text cover the same bytes.  A token points to
its farthest-right overlapping token of the other side; where both end at
one byte, the second side's token is the end of its component and points to
itself.  Doubling the pointers (each takes the pointer of what it points
to) until none moves leads every token to its component's last one, so a
run of n linked tokens takes log2(n) vectorised steps.  The components are
the stretches between bytes where both sides end a token.

Linked pairs of ids are counted over documents.  Frequent pairs are looked
up in the task (a bounded table); the others of a document join the table
of counts, so every pair's count takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, most_frequent, record, stage, texts_of
from chainlens.llm.token_ids import WordIds, byte_letters, encoder, packed

#: Pairs of ids that tasks look up themselves; distinct pairs that a task counts before it hands them on.
HEAD_PAIRS, HELD_PAIRS = 150_000, 4_000_000
#: Tokens aligned at a time.
BLOCK_TOKENS = 200_000
BAR = "▁"  # stands for a space in pieces


class FirstSide:
    """A byte-level tokenizer's ids of `` `` + text, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = encoder(path, plain_specials=True)
        back = {letter: byte for byte, letter in byte_letters().items()}
        t = self.encoder.tokenizer
        self.bytes = [b""] * t.get_vocab_size()
        for token, i in t.get_vocab().items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(" " + text), "<u4")


class SecondSide:
    """A sentencepiece model's ids of a text, which it puts a space before,
    and the bytes of each id.

    A merge makes a piece of the vocabulary.  If no piece has a space after
    another character or a line feed anywhere, none reaches over a word's
    border, and texts are encoded word by word, each distinct word once."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        by_word = True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(BAR, " ").encode())
            by_word &= self.model.is_control(i) or not (BAR in piece.lstrip(BAR) or "\n" in piece)
        self.space = self.model.piece_to_id(BAR)
        self.words = WordIds(self._word)
        probe = " two  spaces\n\n\ta ﬁ é "
        self.by_word = by_word and b"".join(self.bytes[i] for i in self._whole(probe)) == (" " + probe).encode()

    def _whole(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space, or of one that begins with a line feed and follows no space."""
        ids = self._whole(word)
        return packed(ids[1:] if word[:1] == "\n" and ids[:1] == [self.space] else ids)

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word or not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return np.array(self._whole(text), np.uint32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.replace("\n", " \n").split(" "))), "<u4")


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the tokens' end bytes: each first-side token's first and last
    overlapping token, and both sides' component ends, as places on the
    second side."""
    n = len(ends_a)
    starts_a = np.concatenate([[0], ends_a[:-1]]).astype(np.int64)[:n]
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
    over = np.searchsorted(ends_a, ends_b, "left")
    own = n + np.arange(len(ends_b))
    to = np.concatenate([n + last, np.where(ends_a[over] > ends_b, over, own) if n else own])
    while True:
        further = to[to]
        if (further == to).all():
            return first, last, to[:n] - n, to[n:] - n
        to = further


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. lengths[0] - 1, 0, 1, .. lengths[1] - 1, ..."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Aligner:
    """Aligns blocks of documents."""

    def __init__(self, a: FirstSide, b: SecondSide):
        self.a, self.b = a, b
        self.len_a, self.len_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (a, b))
        na, nb = len(a.bytes), len(b.bytes)
        # what an id is followed by in the text form of the groups
        self.said = [f"{i}{c}" for n, marks in ((na, ",|"), (nb, ",;")) for c in marks for i in range(n)]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ids; none where their bytes are not those of the text."""
        none = np.zeros(0, np.uint32)
        if not text:
            return none, none
        want = (" " + text).encode()
        sides = self.a.ids(text), self.b.ids(text)
        same = all(b"".join(map(s.bytes.__getitem__, ids.tolist())) == want for s, ids in zip((self.a, self.b), sides))
        return sides if same else (none, none)

    def align(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """Per document: groups, links, the groups' digest, its distinct pairs' codes and their occurrences."""
        n_a, n_b = (np.array([len(d[k]) for d in docs], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.concatenate([d[k] for d in docs]).astype(np.int64) for k in (0, 1))
        first, last, end_a, end_b = components(np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]))
        na, nb = len(self.a.bytes), len(self.b.bytes)
        closes_a = np.append(end_a[1:] != end_a[:-1], True) if len(end_a) else np.zeros(0, bool)
        closes_b = end_b == np.arange(len(end_b))
        # the block's groups one after the other: first-side ids, then second-side ids
        group_a, group_b = (np.cumsum(c) - c for c in (closes_a, closes_b))
        before_b = np.concatenate([[0], np.flatnonzero(closes_b) + 1])
        after_a = np.flatnonzero(closes_a) + 1
        said = np.empty(len(ids_a) + len(ids_b), np.int64)
        said[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + na * closes_a
        said[np.arange(len(ids_b)) + (after_a[group_b] if len(ids_b) else 0)] = 2 * na + ids_b + nb * closes_b
        text = list(map(self.said.__getitem__, said.tolist()))

        width = last - first + 1
        codes = np.repeat(ids_a, width) * nb + ids_b[np.repeat(first, width) + ramp(width)]
        doc = np.repeat(np.repeat(np.arange(len(docs)), n_a), width)
        links = np.bincount(doc, minlength=len(docs))
        keys, times = np.unique(doc * (na * nb) + codes, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(docs) + 1) * (na * nb))
        groups = np.bincount(np.repeat(np.arange(len(docs)), n_b)[closes_b], minlength=len(docs))
        at = 0
        for k, (x, y) in enumerate(zip(n_a.tolist(), n_b.tolist())):
            digest = hashlib.sha256("".join(text[at:at + x + y])[:-1].encode()).hexdigest() if x else ""
            at += x + y
            own = slice(cuts[k], cuts[k + 1])
            yield int(groups[k]), int(links[k]), digest, keys[own] - k * na * nb, times[own]


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, top): documents of each pair of ids, and whether no pair of its first id has more."""
    def per_batch(batches: Batches) -> Batches:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
        for b in batches:
            new, m = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8"), return_counts=True)
            both, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            codes, n = both, np.bincount(place, np.concatenate([n, m]), len(both)).astype(np.int64)
            if len(codes) > HELD_PAIRS:
                yield record(out, (codes, n))
                codes, n = codes[:0], n[:0]
        yield record(out, (codes, n))

    found = stage(aligned.select("pairs").mapInArrow(per_batch, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    first = F.floor(F.col("pair") / n_b).alias("first")
    best = found.groupBy(first).agg(F.max("n").alias("best"))  # a row per id at most
    return found.select("*", first).join(best, "first").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD_PAIRS) -> DataFrame:
    """Doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``first`` is a byte-level file of tokenizers, ``second`` a sentencepiece
    model that puts a space before the text.  Strings of special tokens in
    texts are plain text.

    Null and empty texts, and texts that either side's tokens do not give
    back byte by byte, have no tokens: zeros and an empty digest.  Repeated
    rows are aligned and counted each; null and repeated ids pass through;
    pairs tied for a first id's highest count all count as best; very long
    texts are aligned whole; other columns, whatever their names, play no
    part; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), *T._parse_datatype_string(
        "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary").fields]

    def per_batch(batches: Batches) -> Batches:
        aligner = aligner_of(first, second)
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), *((f.name, pa.int64()) for f in fields[1:5]),
                                ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
            ids, held, size = b.column(0), [], 0

            def rows(start: int) -> pa.RecordBatch:
                out = [(len(x), len(y), groups, links, digest, codes.astype("<i8").tobytes(), times.astype("<u4").tobytes())
                       for (x, y), (groups, links, digest, codes, times) in zip(held, aligner.align(held))]
                return record(schema, (ids.slice(start, len(held)), *zip(*out)))

            start = 0
            for t in texts_of(b):
                held.append(aligner.tokens(t))
                size += len(held[-1][0]) + len(held[-1][1])
                if size >= BLOCK_TOKENS:
                    yield rows(start)
                    start, held, size = start + len(held), [], 0
            if held:
                yield rows(start)

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(per_batch, T.StructType(fields))
    aligned = stage(found.withColumn("uid", F.monotonically_increasing_id()), "align-docs")
    counts = stage(pair_counts(aligned, len(aligner_of(first, second).b.bytes)), "align-counts")
    frequent = most_frequent(counts, "pair", "n", head)
    frequent.sort(key=lambda r: r.pair)
    head_pairs, head_n = (np.array([r[k] for r in frequent], np.int64) for k in ("pair", "n"))
    head_top = np.array([r.top for r in frequent], bool)

    def look_up(batches: Batches) -> Batches:
        schema = pa.schema([("uid", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
                            ("rest", pa.list_(pa.int64())), ("rest_times", pa.list_(pa.int64()))])
        for b in batches:
            out = []
            for pairs, times in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                codes, n = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(head_pairs, codes), max(0, len(head_pairs) - 1))
                known = head_pairs[at] == codes if len(head_pairs) else np.zeros(len(codes), bool)
                at = at[known]
                out.append((int(n[known][head_top[at]].sum()), int((n[known] * head_n[at]).sum()), codes[~known], n[~known]))
            yield record(schema, (b.column(0), *(zip(*out) if out else [[]] * 4)))

    looked = stage(aligned.select("uid", "pairs", "times").mapInArrow(
        look_up, "uid long, n_best long, count_sum long, rest array<long>, rest_times array<long>"), "align-looked-up")
    rest = (looked.filter(F.size("rest") > 0).select("uid", F.explode(F.arrays_zip("rest", "rest_times")).alias("x"))
            .select("uid", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times")))
    rare = rest.join(counts, "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    return (aligned.drop("pairs", "times").join(looked.select("uid", "n_best", "count_sum"), "uid").join(rare, "uid", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + zero("rare_best")).alias("n_best"),
                    (F.col("count_sum") + zero("rare_sum")).alias("count_sum"), "groups_sha256"))


_open: dict[tuple[str, str], Aligner] = {}


def aligner_of(first: str, second: str) -> Aligner:
    """The worker's aligner for two tokenizer files."""
    if (first, second) not in _open:
        _open[first, second] = Aligner(FirstSide(first), SecondSide(second))
    return _open[first, second]
