"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of the characters of its words (runs of letters,
lower-cased, with an end mark), given up to ``ORDER - 1`` characters of the
word before.  The longest n-grams have their counts; a shorter one counts
the distinct characters seen before it, or its occurrences where it begins
a word and nothing else can stand before it.  Every order takes one
absolute discount off its counts and gives it to the next shorter order.

An n-gram is a 60-bit number of five 12-bit characters (characters beyond
the first 4,000 share hashed numbers), so its end and its context are a
mask and a shift.  A model is one sorted array of n-grams with their
probabilities and one of contexts with their weights per order; a text is
scored by binary search for the distinct n-grams of its distinct words.

The language is the one with the least cross-entropy per character.  Half
of the learning rows are scored by a model of the other half and the other
way round; a logistic curve over length and lead makes those scores the
probability of a right answer, and texts further from their language than
all but a share of ``REJECTED`` of those rows are not accepted.

Learning takes a bounded sample: about ``MAX_ROWS`` rows of each language,
by a hash of id and text, counted in Spark; only the n-grams of that sample
reach the driver.  Scoring covers every row and whole texts in one pass
without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, record, stage, texts_of

#: Learning rows of a language, about.
MAX_ROWS = 3_000
#: Share of right answers that the rejection gives up.
REJECTED = 0.002
ORDER, BITS = 5, 12
END = 1
_KNOWN_CHARS = 4_000
_WORD = re.compile(r"[^\W\d_]+")
#: Code points scored at a time.
BLOCK_CHARS = 4_000_000
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mask(n: int) -> int:
    return (1 << BITS * n) - 1


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character and at each word's end, and where each word's begin."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(("\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = np.where(c < _KNOWN_CHARS, c, _KNOWN_CHARS + c % ((1 << BITS) - _KNOWN_CHARS))
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(c)) - np.repeat(starts, sizes)
    key = c.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(c)
        before[back:] = c[:-back]
        key |= np.where(place >= back, before, 0) << (BITS * back)
    return key, starts


class Model:
    """One language: per order, sorted n-grams with probabilities and sorted contexts with weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        levels, types = [], counts
        for n in range(ORDER, 0, -1):
            begins = (keys >> (BITS * (n - 1))) == 0
            levels.append((keys, np.where(begins | (n == ORDER), counts, types).astype(np.float64)))
            shorter, place, types = np.unique(keys & mask(n - 1), return_inverse=True, return_counts=True)
            counts = np.bincount(place, counts, len(shorter))
            keys = shorter
        self.orders: list[tuple[np.ndarray, ...]] = []
        self.even = 1 / (alphabet + 1)
        for n, (g, c) in zip(range(1, ORDER + 1), reversed(levels)):
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            contexts, place = np.unique(g >> BITS, return_inverse=True)
            total, kinds = np.bincount(place, c), np.bincount(place)
            weight = discount * kinds / total
            p = (c - discount) / total[place] + weight[place] * self.probability(g, n - 1)
            self.orders.append((g, p, contexts, weight))

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last character of each n-gram, given those before it."""
        p = np.full(len(keys), self.even)
        for n, (g, own, contexts, weight) in zip(range(1, order + 1), self.orders):
            k = keys & mask(n)
            at, c = find(g, k), find(contexts, k >> BITS)
            p = np.where(at >= 0, own[at], np.where(c >= 0, weight[c], 1.0) * p)
        return p


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 where absent."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def entropies(models: list[Model], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of each text, cross-entropy per character with each model)."""
    n, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(models)))

    def block(first: int, found: list[list[str]]) -> None:
        distinct = list(dict.fromkeys(w for words in found for w in words))
        if not distinct:
            return
        number = {w: i for i, w in enumerate(distinct)}
        keys, starts = grams(distinct)
        only, place = np.unique(keys, return_inverse=True)
        logs = np.stack([np.log(m.probability(only)) for m in models], 1)
        per_word = np.add.reduceat(logs[place], starts)
        sizes = np.diff(starts, append=len(keys))
        for k, words in enumerate(found, first):
            if words:
                at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                n[k] = sizes[at].sum()
                out[k] = -per_word[at].sum(0) / n[k]

    held, size = [], 0
    for k, t in enumerate(texts):
        held.append(words_of(t))
        size += len(t)
        if size >= BLOCK_CHARS:
            block(k + 1 - len(held), held)
            held, size = [], 0
    block(len(texts) - len(held), held)
    return n, out


def evidence(n: np.ndarray, ce: np.ndarray) -> np.ndarray:
    """What the right answer's probability rests on: the lead over the second language, per character and in all, and the length."""
    two = np.sort(ce, 1)[:, :2]
    lead = two[:, 1] - two[:, 0] if ce.shape[1] > 1 else np.ones(len(ce))
    return np.stack([np.ones(len(n)), lead, np.minimum(lead * n, 50) / 10, np.log1p(n) / 5], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method; the ridge bounds them where every answer is right."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Identifier:
    """Languages with their models, the calibration and the rejection's bounds."""

    def __init__(self, langs: list[str], models: list[Model]):
        self.langs, self.models = langs, models
        self.weights, self.middle, self.spread, self.far = np.array([0.0, 5.0, 1.0, 0.0]), np.zeros(len(langs)), np.ones(len(langs)), np.inf

    def calibrate(self, n: np.ndarray, ce: np.ndarray, right: np.ndarray) -> None:
        """From rows scored by models that did not learn from them; ``right`` is each row's language."""
        if not len(n):
            return
        best = ce.argmin(1)
        self.weights = logistic(evidence(n, ce), (best == right).astype(np.float64))
        own = ce[np.arange(len(n)), right]
        for k in range(len(self.langs)):
            if (right == k).sum() > 1:
                self.middle[k] = np.median(own[right == k])
                self.spread[k] = np.sqrt(np.mean((own[right == k] - self.middle[k]) ** 2 * n[right == k])) + 1e-6
        good = best == right
        if good.any():
            self.far = float(np.quantile(self.distance(n, ce)[good], 1 - REJECTED))

    def distance(self, n: np.ndarray, ce: np.ndarray) -> np.ndarray:
        """How far a text's cross-entropy is above its language's, in deviations at its length."""
        best = ce.argmin(1)
        return (ce[np.arange(len(ce)), best] - self.middle[best]) / self.spread[best] * np.sqrt(n)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted, of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        n, ce = entropies(self.models, texts)
        some = n > 0
        score = np.where(some, 1 / (1 + np.exp(-np.clip(evidence(n, ce) @ self.weights, -40, 40))), 0.0)
        langs = [self.langs[k] if s else UNDETERMINED for k, s in zip(ce.argmin(1).tolist(), some.tolist())]
        return langs, score, some & (self.distance(n, ce) <= self.far)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Identifier:
    """Models of every non-null language among ``docs``."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_col)).alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Identifier([], [])
    number = F.create_map(*[x for i, v in enumerate(langs) for x in (F.lit(v), F.lit(i))])[F.col("lang")]
    share = F.create_map(*[x for v in langs for x in (F.lit(v), F.lit(min(1.0, max_rows / sizes[v])))])[F.col("lang")]
    uniform = F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20)
    sample = stage(rows.filter(uniform < share).select(
        number.cast("int").alias("lang"), "text", F.pmod(F.shiftright("h", 21), F.lit(2)).cast("int").alias("half")), "language-sample")

    def count(batches: Batches) -> Batches:
        for b in batches:
            words: dict[tuple[int, int], Counter] = {}
            for lang, t, half in zip(*(c.to_pylist() for c in b.columns)):
                words.setdefault((lang, half), Counter()).update(words_of(t))
            for (lang, half), n in words.items():
                keys, starts = grams(list(n))
                per_key = np.repeat(np.array(list(n.values()), np.float64), np.diff(starts, append=len(keys)))
                only, place = np.unique(keys, return_inverse=True)
                yield record(pa.schema([("lang", pa.int32()), ("half", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())]),
                             (np.full(len(only), lang, np.int32), np.full(len(only), half, np.int32), only,
                              np.bincount(place, per_key, len(only)).astype(np.int64)))

    found = sample.mapInArrow(count, "lang int, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, half, gram, n = (found.column(c).to_numpy() for c in ("lang", "half", "gram", "n"))
    alphabet = len(np.unique(gram & mask(1)))

    def models(taken: np.ndarray) -> list[Model] | None:
        out = []
        for k in range(len(langs)):
            own = taken & (lang == k)
            if not own.any():
                return None
            keys, place = np.unique(gram[own], return_inverse=True)
            out.append(Model(keys, np.bincount(place, n[own]), alphabet))
        return out

    present = sorted(set(lang.tolist()))
    if len(present) < len(langs):  # a language without a letter in any sampled text has no model
        langs, lang = [langs[k] for k in present], np.searchsorted(present, lang)
    if not langs:
        return Identifier([], [])
    out = Identifier(langs, models(np.ones(len(lang), bool)))
    halves = [models(half == k) for k in (0, 1)]
    if all(halves):
        def cross(batches: Batches) -> Batches:
            for b in batches:
                rights, texts, own = (c.to_pylist() for c in b.columns)
                for k in (0, 1):
                    at = [i for i, h in enumerate(own) if h == k]
                    size, ce = entropies(halves[1 - k], [texts[i] for i in at])
                    yield record(pa.schema([("lang", pa.int32()), ("n", pa.int64()), ("ce", pa.list_(pa.float64()))]),
                                 ([rights[i] for i in at], size, list(ce)))

        judged = sample.mapInArrow(cross, "lang int, n long, ce array<double>").filter("n > 0").toArrow()  # a row per sampled document
        rights = np.searchsorted(present, judged.column("lang").to_numpy())
        out.calibrate(judged.column("n").to_numpy(), np.array(judged.column("ce").to_pylist()).reshape(-1, len(langs)), rights)
    return out


def identify(docs: DataFrame, model: Identifier, carry: tuple[Column, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, columns of ``carry``, lang_pred, score, accepted) of every row.

    Null texts and texts without a letter are ``und`` with score 0 and are
    not accepted, as is every text where no language was learned.  Ties go
    to the first language by name.  Null and repeated ids pass through;
    very long texts are scored whole; other columns, whatever their names,
    play no part; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)
    carried = [f for f in own.schema if f.name != "text"]
    fields = [*carried, *T._parse_datatype_string("lang_pred string, score double, accepted boolean").fields]

    def per_batch(batches: Batches) -> Batches:
        for b in batches:
            langs, score, accepted = model.judge(texts_of(b))
            kept = [c for i, c in enumerate(b.columns) if i != 1]
            schema = pa.schema([(f.name, c.type) for f, c in zip(carried, kept)]
                               + [("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
            yield record(schema, (*kept, langs, score, accepted))

    return own.mapInArrow(per_batch, T.StructType(fields))
