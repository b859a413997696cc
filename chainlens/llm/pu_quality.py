"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything without a label is
unlabelled web text, a blend of both classes.  With class prior pi, loss l
and scores g, the classifier minimises the non-negative unbiased risk

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

with a sigmoid loss; when a batch's second part falls below zero, the step
goes up on that part instead, which is what keeps a flexible model from
fitting the unlabelled text as negatives.  The prior is estimated from the
same two sets: scores of an ordinary positive-against-unlabelled fit are
counted and split at every threshold, and the share of unlabelled text
that no threshold can explain by positives bounds the negatives.

Features are shares of a text (symbols, capitals, digits, repeats, word
lengths, ...) and hashed word shapes, from the whole text, computed once
per row and stored.  The networks are fitted on a bounded sample
(``MAX_POSITIVE`` labelled rows, ``MAX_UNLABELLED`` rows without labels, the
first by a hash of their id); the prior and the class boundary rest on
counts of the scores of all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, record, stage, texts_of

MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
SHAPES = 256
DENSE = 14
HIDDEN = 16
WIDTH = 2 * DENSE + SHAPES

#: Shape of a byte: letters a or A, digits 0, other bytes of UTF-8 letters a, the rest itself.
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"a+|A+|0+")


def text_features(text: str) -> np.ndarray:
    """Features of a whole text; zeros but for the length terms where it has no words."""
    raw = text.encode()
    words = raw.split()
    shape = raw.translate(_SHAPE)
    n, size = len(words), len(raw) + 1
    count = Counter(words)
    shapes = Counter(_RUNS.sub(lambda m: m[0][:1], shape).split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    letters = shape.count(b"a") + shape.count(b"A") + 1
    pairs = Counter(zip(words, words[1:]))
    top = count.most_common(1)[0][1] if count else 0
    dense = np.array([
        np.log1p(n) / 10, np.log1p(len(lines)) / 5,
        sum(shape.count(c) for c in b"#*$%&|<>") / size, shape.count(b"A") / letters, shape.count(b"0") / size,
        (shape.count(b"!") + shape.count(b"?")) / size, (shape.count(b".") + shape.count(b",")) / size,
        len(count) / (n + 1), len(pairs) / (n + 1), top / (n + 1),
        1 - len(set(lines)) / (len(lines) or 1), lengths.mean() / 20, lengths.std() / 20,
        1 - (letters + shape.count(b"0")) / size])
    hashed = np.zeros(SHAPES)
    for s, c in shapes.items():
        hashed[zlib.crc32(s) % SHAPES] += c
    return np.concatenate([dense, np.sqrt(np.abs(dense)), np.sqrt(hashed / (n + 1))]).astype(np.float32)


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.stack([text_features(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)


class Net:
    """One hidden layer of rectified units; ``grad`` takes dloss/dscore."""

    def __init__(self, width: int, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.p = [x.astype(np.float32) for x in self.p]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def grad(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        h = np.maximum(x @ self.p[0] + self.p[1], 0)
        dh = np.outer(d, self.p[2]) * (h > 0)
        return [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def step(self, g: list[np.ndarray], rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.t += 1
        for k, (p, g_) in enumerate(zip(self.p, g, strict=True)):
            g_ = g_ + decay * p
            self.m[k] = 0.9 * self.m[k] + 0.1 * g_
            self.v[k] = 0.999 * self.v[k] + 0.001 * g_ * g_
            p -= rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Scores are counted in steps of 1 / STEPS between -MOST and MOST.
STEPS, MOST = 50, 40


def bins(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -MOST, MOST) * STEPS).astype(np.int64)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from both sets' counts of
    scores in rising order: the least that leaves no region of scores with
    more positives than unlabelled rows, with two standard errors of slack."""
    fp, fu = (np.cumsum(x) / max(1, x.sum()) for x in (pos, unl))
    slack = 2 * np.sqrt(fu * (1 - fu) / max(1, unl.sum())) + 2 * np.sqrt(fp * (1 - fp) / max(1, pos.sum()))
    negatives = np.max((fu - fp - slack) / np.maximum(1 - fp, 0.2), initial=0.0)
    return float(np.clip(1 - negatives, 0.05, 0.99))


def scaling(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([pos, unl]).astype(np.float32)
    return both.mean(0), both.std(0) + 1e-3


def scaled(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip((x.astype(np.float32) - scale[0]) / scale[1], -8, 8)


def ordinary(pos: np.ndarray, unl: np.ndarray, batch: int = 512, seed: int = 0) -> Net:
    """Positives against unlabelled rows, from scaled features."""
    r, net = np.random.default_rng(seed), Net(pos.shape[1], seed)
    for _ in range(400):
        xp, xu = pos[r.integers(0, len(pos), batch)], unl[r.integers(0, len(unl), batch)]
        net.step([a + b for a, b in zip(net.grad(xp, -sigmoid(-net(xp)) / batch), net.grad(xu, sigmoid(net(xu)) / batch), strict=True)])
    return net


def minimise(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 30, batch: int = 512, seed: int = 0) -> Net:
    """The non-negative risk's minimiser, from scaled features."""
    r = np.random.default_rng(seed)

    def batches():
        steps = max(1, -(-len(unl) // batch))
        for _ in range(max(epochs, -(-400 // steps))):
            pi, ui = r.permutation(len(pos)), r.permutation(len(unl))
            for k in range(steps):
                yield pos[np.resize(np.roll(pi, -k * batch), min(batch, len(pos)))], unl[ui[k * batch:(k + 1) * batch]]

    net = Net(pos.shape[1], seed + 1)
    for xp, xu in batches():
        gp, gu = net(xp), net(xu)
        lp, lm = sigmoid(gp), sigmoid(gu)  # l(-g) of either set; l(g) = 1 - that
        rest = lm.mean() - prior * lp.mean()
        slope_p, slope_u = lp * (1 - lp) / len(gp), lm * (1 - lm) / len(gu)
        if rest >= 0:
            g = [a + b for a, b in zip(net.grad(xp, -2 * prior * slope_p), net.grad(xu, slope_u), strict=True)]
        else:
            g = [a + b for a, b in zip(net.grad(xp, prior * slope_p), net.grad(xu, -slope_u), strict=True)]
        net.step(g)
    return net


def quantile(counts: np.ndarray, q: float) -> float:
    """Score below which a share ``q`` of the counted rows lies, to a step."""
    at = np.searchsorted(np.cumsum(counts), q * counts.sum(), "left")
    return (min(int(at), len(counts) - 1) - MOST * STEPS + 0.5) / STEPS


def raw_scores(net: Net, scale: tuple, x: np.ndarray) -> np.ndarray:
    return net(scaled(x, scale))


def scores(model: dict | None, x: np.ndarray, boundary: float = 0.5) -> np.ndarray:
    """Scores between 0 and 1; the class boundary gets ``boundary``."""
    if model is None:
        return np.full(len(x), 0.5)
    return sigmoid(raw_scores(model["net"], model["scale"], x) - model["middle"] + np.log(boundary / (1 - boundary)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, columns of ``carry``, x) of every row, written once: learning
    and scoring read the texts no more.  x holds ``WIDTH`` half-precision numbers."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)
    kept = [f for f in own.schema if f.name != "text"]

    def per_batch(batches: Batches) -> Batches:
        for b in batches:
            columns = [c for i, c in enumerate(b.columns) if i != 1]
            schema = pa.schema([(f.name, c.type) for f, c in zip(kept, columns)] + [("x", pa.binary())])
            yield record(schema, (*columns, [f.astype("<f2").tobytes() for f in feature_matrix(texts_of(b))]))

    return stage(own.mapInArrow(per_batch, T.StructType([*kept, T.StructField("x", T.BinaryType())])), "quality-features")


def matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f2").reshape(len(raw), WIDTH)


def learn(found: DataFrame, trusted: DataFrame, labelled: DataFrame, id_col: str = "doc_id",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict | None:
    """Model from ``features`` and the ids of trusted positives and of all
    labelled rows; None without either set.

    The networks are fitted on a sample: the first rows by a hash of their
    id, at most the two parameters' numbers, whose features are all that
    reaches the driver.  The class prior and the boundary rest on counts of
    the scores of every row.  For the prior each row is scored by the
    network of the other half of the rows."""
    half = F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(2)).cast("int")
    rows = found.filter(F.col("doc_id").isNotNull()).withColumn("half", half)
    sure = trusted.select(F.col(id_col).alias("doc_id")).distinct()
    known = labelled.select(F.col(id_col).alias("doc_id")).distinct()
    ids = rows.select("doc_id")

    def sample(chosen: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        first = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)  # at most n ids: small enough to broadcast
        got = rows.join(F.broadcast(first), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").select("x", "half").limit(n).collect()
        return (np.stack([np.frombuffer(r.x, "<f2") for r in got]) if got else np.zeros((0, WIDTH), np.float16)), np.array([r.half for r in got], int)

    pos, pos_half = sample(ids.join(sure, "doc_id", "left_semi"), max_positive)
    unl, unl_half = sample(ids.join(known, "doc_id", "left_anti"), max_unlabelled)
    if not len(pos) or not len(unl):
        return None
    scale = scaling(pos, unl)
    pos, unl = scaled(pos, scale), scaled(unl, scale)

    def counts(nets: list[Net]) -> tuple[np.ndarray, np.ndarray]:
        """Rows by bin of their score with the network of their half: (positives, unlabelled), per half."""
        def per_batch(batches: Batches) -> Batches:
            for b in batches:
                x, own = matrix(b.column(1)), b.column(2).to_numpy()
                z = np.zeros(len(x))
                for k in range(len(nets)):
                    at = (own if len(nets) > 1 else np.zeros(len(x), int)) == k
                    z[at] = raw_scores(nets[k], scale, x[at])
                yield record(pa.schema([("doc_id", b.column(0).type), ("half", pa.int32()), ("bin", pa.int64())]), (b.column(0), b.column(2), bins(z)))

        kinds = T.StructType([rows.schema["doc_id"], T.StructField("half", T.IntegerType()), T.StructField("bin", T.LongType())])
        scored = stage(rows.select("doc_id", "x", "half").mapInArrow(per_batch, kinds), "quality-bins")
        out = []
        for own in (scored.join(sure, "doc_id", "left_semi"), scored.join(known, "doc_id", "left_anti")):
            table = np.zeros((2, 2 * MOST * STEPS + 1), np.int64)
            for r in own.groupBy("half", "bin").agg(F.count("*").alias("n")).collect():  # at most the bins
                table[r.half, r.bin + MOST * STEPS] = r.n
            out.append(table)
        return out[0], out[1]

    # of a half without either set, the other half's network speaks as well
    each = [ordinary(pos[pos_half != k] if (pos_half != k).any() else pos, unl[unl_half != k] if (unl_half != k).any() else unl, seed=k) for k in (0, 1)]
    by_pos, by_unl = counts(each)
    there = [k for k in (0, 1) if by_pos[k].sum() and by_unl[k].sum()] or [0]
    prior = float(np.average([class_prior(by_pos[k], by_unl[k]) for k in there], weights=[max(1, by_unl[k].sum()) for k in there]))
    net = minimise(pos, unl, prior)
    by_pos, by_unl = (x.sum(0) for x in counts([net]))
    # the class boundary lies between the scores that the prior leaves to negatives and the trusted positives' low end
    middle = (quantile(by_unl, 1 - prior) + quantile(by_pos, 0.005)) / 2
    return {"net": net, "scale": scale, "prior": prior, "middle": middle}


def score(found: DataFrame, model: dict | None, boundary: float = 0.5) -> DataFrame:
    """``features`` with ``score``, the probability-like score of label 1, for x.

    Null and empty texts have features of their own and a score like any
    other; repeated rows score alike; null ids pass through and are not
    learned from; ties of the sample's hash go to the smaller id; very long
    texts are read whole; other columns, whatever their names, play no part;
    without a model every score is 0.5; an empty table gives an empty result.
    """
    kept = [f for f in found.schema if f.name != "x"]

    def per_batch(batches: Batches) -> Batches:
        for b in batches:
            s = scores(model, matrix(b.column(len(kept))), boundary).astype(np.float64)
            schema = pa.schema([(f.name, c.type) for f, c in zip(kept, b.columns)] + [("score", pa.float64())])
            yield record(schema, (*b.columns[:-1], s))

    return found.select(*(f.name for f in kept), "x").mapInArrow(per_batch, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
