"""LM scoring with a gated recurrent language model.

Tokens are words in ASCII lower case, then one end.  Counting: every task
sums its words and Spark adds them up.  Encoding: up to ``HEAD`` of the
most frequent words (a bounded table) are looked up in the task; the remaining
words of a document join the count table, so every word's count takes
part, however many there are.  Words beyond the model's vocabulary are its
unknown token times their add-one unigram share among such words, so the
model gives every text a probability.  The vocabulary grows with the corpus:
every word seen ``OFTEN`` times is in it, up to ``MOST_WORDS``.

The network is a gated recurrent unit in numpy with an output softmax
factored into classes: P(word) = P(class | state) P(word | class, state).
It is trained by truncated backpropagation through time over windows of
``STEPS`` tokens, states carried on from window to window, on all training
documents: each round's share of the documents is trained on in parallel
from the same parameters, and the partitions' parameters are averaged,
weighted by their tokens, in a tree whose tasks read ``FAN_IN`` nets each.
Documents follow each other in lanes of near-equal length, so that windows
stay full.  Scoring carries the state through the whole document, so a long
text costs time but never memory, and is never cut.
"""

from __future__ import annotations

import functools
import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import Batches, record, stage

#: Words looked up in the task; rarer ones are looked up by a join.
HEAD = 262_144
#: Documents whose words are encoded at a time.
ROWS = 1_024
#: The model's words: all that training holds this often, within these bounds (the parameters go to every task).
OFTEN, LEAST_WORDS, MOST_WORDS = 64, 2_048, 16_384
UNITS, STEPS, LANES, RATE = 16, 32, 1_024, 0.01
#: Tokens of a training step at least; width of the classes.
BATCH, SPREAD = 16_384, 3.0
#: Tokens whose class outputs are held at a time: they stay in the processor's cache.
CHUNK = 2_048
#: Rows of a parameter that are moved at a time.
BLOCK = 1_024
#: Windows that are copied from the lanes at a time.
COPIED = 8
#: Nets that one task of the averaging tree reads.
FAN_IN = 16
LOG2_E = math.log2(math.e)
ROUNDS = 3
END, UNKNOWN = 0, 1
#: Key of the end token; no word has white space.
END_KEY = " "
#: Bytes of a word beyond which its key is a digest.
LENGTHY = 48


def key_of(word: bytes) -> str:
    """The word itself; a digest for words that are long."""
    return word.decode() if len(word) <= LENGTHY else " " + xxhash.xxh3_128_hexdigest(word)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys of the distinct words of ``texts``, the key of every word, text
    after text, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten().dictionary_encode()
    keys, word, sizes = found.dictionary.cast(pa.string()), found.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
    if (empty := pc.index(keys, "").as_py()) >= 0:  # white space at an end of a text
        full = word != empty
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        word, sizes = word[full], np.bincount(text[full], minlength=len(sizes))
    lengthy = pc.greater(pc.binary_length(keys), LENGTHY)
    if pc.any(lengthy).as_py():
        keys = pc.replace_with_mask(keys, lengthy, pa.array([key_of(w.encode()) for w in keys.filter(lengthy).to_pylist()], pa.string()))
    return keys, word, sizes


# ---------------------------------------------------------------- the network

@functools.lru_cache(maxsize=8)
def class_bounds(n: int) -> np.ndarray:
    """First id of each class, then ``n``.  The end and the unknown token,
    nearly half of all tokens, are classes of their own; after them ids fall
    in frequency and a class holds about ``SPREAD`` times the root of its
    first word's rank: few words where tokens are many, so that a token meets
    few outputs on average."""
    out, at = [0, 1], 2
    while at < n:
        out.append(at)
        at += max(1, round(SPREAD * math.sqrt(at - 1)))
    return np.array(out + [n], np.int64)


@functools.lru_cache(maxsize=8)
def classes_of(n: int) -> np.ndarray:
    """The class of each id."""
    sizes = np.diff(class_bounds(n))
    return np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)


def new_net(counts: np.ndarray, units: int = UNITS, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters for ids 0..len(counts)-1, at least two; biases start at the unigram model."""
    r = np.random.default_rng(seed)
    n = len(counts)
    share = (counts + 1) / (counts + 1).sum()
    of_class = np.add.reduceat(share, class_bounds(n)[:-1])
    net = {"U": r.normal(0, 0.1, (n, 3 * units)), "W": r.normal(0, units ** -0.5, (units, 3 * units)), "b": np.zeros(3 * units),
           "C": r.normal(0, 0.1, (units + 1, len(of_class))), "O": r.normal(0, 0.1, (n, units + 1))}
    # the outputs' last weight is the bias
    net["C"][-1], net["O"][:, -1] = np.log(of_class), np.log(share / of_class[classes_of(n)])
    return {k: v.astype(np.float32) for k, v in net.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; powers of two take numpy half the time of ``exp``."""
    x *= -LOG2_E
    np.exp2(x, x)
    x += 1
    return np.reciprocal(x, x)


class Window:
    """Steps of lanes: inputs, targets and documents, each (steps, lanes); the lanes that run at each step come first."""

    def __init__(self, block: np.ndarray, runs: list[int]):
        self.x, self.fresh, self.y, self.doc = block
        self.any_fresh = self.fresh.any(1).tolist()
        self.runs = runs
        self.steps = [0, *np.cumsum(runs).tolist()]

    def flat(self, rows: np.ndarray) -> np.ndarray:
        """Step after step, the running lanes alone."""
        return np.concatenate([rows[t, :m] for t, m in enumerate(self.runs)])


def lanes_of(docs: list[np.ndarray], lanes: int) -> list[np.ndarray]:
    """Documents one after the other in near-equal lanes, the longest lane
    first: per lane the rows input, first token of a document, target and
    document."""
    heap = [(0, k) for k in range(min(lanes, len(docs)))]
    held: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (size + len(docs[i]), k))
    out = []
    for k, own in enumerate(held):
        order = np.random.default_rng(k).permutation(own)
        sizes = np.array([len(docs[i]) for i in order])
        y = np.concatenate([docs[i] for i in order]).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        lane = np.zeros((4, len(y)), np.int32)
        lane[0, 1:] = y[:-1]
        lane[0, starts] = END
        lane[1, starts] = 1
        lane[2], lane[3] = y, np.repeat(order, sizes)
        out.append(lane)
    return sorted(out, key=lambda lane: -lane.shape[1])


def windows(lanes: list[np.ndarray], steps: int) -> Iterator[Window]:
    """Windows of ``steps`` steps, copied from the lanes ``COPIED`` at a time."""
    lengths = np.array([lane.shape[1] for lane in lanes])
    for a in range(0, int(lengths.max(initial=0)), COPIED * steps):
        live, span = int((lengths > a).sum()), min(COPIED * steps, int(lengths[0]) - a)
        block = np.zeros((4, span, live), np.int32)
        for k in range(live):
            part = lanes[k][:, a:a + span]
            block[:, :part.shape[1], k] = part
        runs = (len(lengths) - np.searchsorted(lengths[::-1], np.arange(a, a + span), "right")).tolist()
        for t in range(0, span, steps):
            yield Window(block[:, t:t + steps, : runs[t]], runs[t:t + steps])


def run_window(net: dict, h: np.ndarray, w: Window) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """State after the window (a row a lane), the state at each of its tokens
    (a column a token) and, per step, what backpropagation needs.  A document
    starts from the zero state; lanes that have ended stay behind.  Gates lie
    row after row, so that each is one block in memory."""
    units, kept, states = h.shape[1], [], np.empty((h.shape[1], w.steps[-1]), h.dtype)
    h, weights = np.ascontiguousarray(h.T), np.ascontiguousarray(net["W"].T)
    gates = np.take(net["U"], w.flat(w.x), axis=0)
    gates += net["b"]
    for t, m in enumerate(w.runs):
        prev, new_doc = h[:, :m], None
        if w.any_fresh[t]:
            new_doc = np.flatnonzero(w.fresh[t, :m])
            prev = prev.copy()
            prev[:, new_doc] = 0
        gx, gh = np.ascontiguousarray(gates[w.steps[t]:w.steps[t + 1]].T), weights @ prev
        zr, n, ghn = gx[:2 * units], gx[2 * units:], gh[2 * units:]
        zr += gh[:2 * units]
        sigmoid(zr)
        z, r = zr[:units], zr[units:]
        n += r * ghn
        np.tanh(n, n)
        new = prev - n
        new *= z
        new += n
        kept.append((new_doc, prev, z, r, n, ghn))
        states[:, w.steps[t]:w.steps[t + 1]] = new
        h = new if m == h.shape[1] else np.concatenate([new, h[:, m:]], axis=1)  # the state before is kept
    return h.T, states, kept


def softmax_at(a: np.ndarray, spots: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of ``spots`` under a softmax over the first axis, and one over its sum;
    ``a``, in units of log 2, is overwritten by the softmax's terms."""
    if a.max() > 86:  # exp2 would leave single precision
        a -= a.max(0)
    picked = a[spots]
    np.exp2(a, a)
    total = a.sum(0)
    picked -= np.log2(total)
    picked *= 1 / LOG2_E
    return picked, np.reciprocal(total, total)


def outputs(net: dict, h: np.ndarray, y: np.ndarray, g: dict | None = None):
    """Log-probability of each target, ``h`` a column each; with ``g`` also d(-sum)/dh, the parameters' gradients added to ``g``."""
    n, units, grad = len(net["O"]), len(h), g is not None
    bounds, cls = class_bounds(n), classes_of(n)[y]
    order = np.argsort(cls, kind="stable")  # class by class
    cls, ids, rows = cls[order], y[order], np.arange(len(y))
    states = np.ones((units + 1, len(y)), h.dtype)
    np.take(h, order, axis=1, out=states[:-1], mode="clip")
    logp = np.empty(len(y), h.dtype)
    dh = np.empty((units, len(y)), h.dtype) if grad else None
    classes = net["C"].T * LOG2_E
    for first in range(0, len(y), CHUNK):
        part = slice(first, min(first + CHUNK, len(y)))
        own = states[:, part]
        a = classes @ own
        logp[part], share = softmax_at(a, (cls[part], rows[: part.stop - first]))
        if grad:  # the shares scale the narrow side of each product
            g["C"] += (a @ (own * share).T).T
            np.multiply((a.T @ net["C"][:-1].T).T, share, dh[:, part])
    cuts = np.searchsorted(cls, np.arange(len(bounds)))
    if grad:  # less the targets' own classes
        held = np.flatnonzero(np.diff(cuts))
        g["C"][:, held] -= np.add.reduceat(states, cuts[held], axis=1)
        dh -= np.repeat(net["C"][:-1], np.diff(cuts), axis=1)
    for k in np.flatnonzero((np.diff(bounds) > 1) & (np.diff(cuts) > 0)).tolist():
        (s, e), (first, last) = bounds[k:k + 2], cuts[k:k + 2]
        own, words = states[:, first:last], net["O"][s:e]
        a = (words * LOG2_E) @ own
        spots = (ids[first:last] - s, rows[: last - first])
        more, share = softmax_at(a, spots)
        logp[first:last] += more
        if grad:
            a *= share
            a[spots] -= 1
            g["O"][s:e] += a @ own.T
            dh[:, first:last] += (a.T @ words[:, :-1]).T
    back_in_order = np.empty_like(order)
    back_in_order[order] = rows
    return (logp[back_in_order], np.take(dh, back_in_order, axis=1)) if grad else logp[back_in_order]


def back(net: dict, w: Window, kept: list[tuple], dh: np.ndarray, g: dict) -> None:
    """Truncated backpropagation through one window's steps, added to ``g``; U's rows as (ids, gradients)."""
    units = net["W"].shape[0]
    carry = np.zeros((units, w.runs[0]), dh.dtype)
    gates = np.empty((3 * units, dh.shape[1]), dh.dtype)
    for t in range(len(w.runs) - 1, -1, -1):
        m, (new_doc, prev, z, r, n, ghn) = w.runs[t], kept[t]
        at = slice(w.steps[t], w.steps[t + 1])
        d = dh[:, at] + carry[:, :m]
        dgh = np.empty((3 * units, m), dh.dtype)
        dz, dr, dn = dgh[:units], dgh[units:2 * units], dgh[2 * units:]
        dkeep = 1 - z
        dkeep *= d
        d *= z  # from here on the part that passes to the state before
        np.multiply(n, n, dn)
        np.subtract(1, dn, dn)
        dn *= dkeep
        np.subtract(prev, n, dz)
        dz *= z
        dz *= dkeep
        np.subtract(1, r, dr)
        dr *= r
        dr *= ghn
        dr *= dn
        gates[:, at] = dgh
        dn *= r
        g["W"] += prev @ dgh.T
        d += net["W"] @ dgh
        if new_doc is not None:
            d[:, new_doc] = 0
        carry[:, :m] = d
    g["b"] += gates.sum(1)
    ids = w.flat(w.x)
    order = np.argsort(ids.astype(np.uint16) if len(net["O"]) <= 1 << 16 else ids, kind="stable")
    first = np.diff(ids[order], prepend=-1) > 0
    ids, at = ids[order][first], np.empty_like(order)
    at[order] = np.cumsum(first) - 1
    rows = np.empty((len(ids), len(gates)), dh.dtype)
    for k, gate in enumerate(gates):
        rows[:, k] = np.bincount(at, gate, len(ids))
    g["U"].append((ids, rows))


def no_gradient(net: dict) -> dict:
    return {k: [] if k == "U" else np.zeros_like(v) for k, v in net.items()}


class Adam:
    """U's rows move where they have a gradient, the other parameters at every step."""

    def __init__(self, net: dict):
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))
        self.t = 0

    def step(self, net: dict, g: dict, n: int, rate: float) -> None:
        """A step along the gradient ``g`` of ``n`` tokens, which is emptied."""
        self.t += 1
        a, b = rate / (1 - 0.9 ** self.t), 1 / (1 - 0.999 ** self.t)
        for k, own in g.items():
            if k == "U":
                ids, x = own[0]
                if len(own) > 1:
                    ids = np.unique(np.concatenate([i for i, _ in own]))
                    x = np.zeros((len(ids), net["U"].shape[1]), net["U"].dtype)
                    for i, part in own:
                        x[np.searchsorted(ids, i)] += part
                own.clear()
            else:
                ids, x = None, own
            for first in range(0, len(x), BLOCK):  # as many rows as stay in the processor's cache
                self.move(net, k, ids[first:first + BLOCK] if k == "U" else slice(first, first + BLOCK), x[first:first + BLOCK], n, a, b)
            if k != "U":
                own[...] = 0

    def move(self, net: dict, k: str, ids: np.ndarray | slice, x: np.ndarray, n: int, a: float, b: float) -> None:
        """Rows ``ids`` of parameter ``k`` along their gradient ``x``, which is overwritten."""
        x *= 1 / n
        m, v = self.m[k][ids], self.v[k][ids]
        more = x - m
        more *= 0.1
        m += more
        x *= x
        x -= v
        x *= 0.001
        v += x
        if k == "U":
            self.m[k][ids], self.v[k][ids] = m, v
        np.multiply(v, b, x)
        np.sqrt(x, x)
        x += 1e-8
        np.divide(m, x, x)
        x *= a
        net[k][ids] -= x


def learn(net: dict, held: list[tuple[Window, np.ndarray, list]], g: dict) -> int:
    """The gradient of windows that ran from the same parameters, added to ``g``: their outputs in one
    pass, so that windows of few lanes cost no more a token than full ones.  Tokens seen."""
    _, dh = outputs(net, np.concatenate([states for _, states, _ in held], axis=1), np.concatenate([w.flat(w.y) for w, _, _ in held]), g)
    at = 0
    for w, states, kept in held:
        back(net, w, kept, dh[:, at:at + w.steps[-1]], g)
        at += w.steps[-1]
    return at


def train(net: dict, opt: Adam, docs: list[np.ndarray], lanes: int = LANES, steps: int = STEPS, rate: float = RATE) -> int:
    """One pass over ``docs``; a step whenever windows of ``BATCH`` tokens have passed.  Tokens seen."""
    packed_lanes = lanes_of(docs, lanes)
    h = np.zeros((len(packed_lanes), net["W"].shape[0]), net["b"].dtype)
    g, held, n, seen = no_gradient(net), [], 0, 0
    with np.errstate(over="ignore"):
        for w in windows(packed_lanes, steps):
            h, states, kept = run_window(net, h[: w.runs[0]], w)
            held.append((w, states, kept))
            n += w.steps[-1]
            if n >= BATCH:
                opt.step(net, g, learn(net, held, g), rate)
                held, n, seen = [], 0, seen + n
        if held:  # few tokens give a noisy gradient: a smaller step
            opt.step(net, g, learn(net, held, g), rate * min(1.0, n / 2048))
            seen += n
    return seen


def log_likelihood(net: dict, docs: list[np.ndarray], lanes: int = LANES, steps: int = STEPS) -> np.ndarray:
    """Natural log-probability of each whole document."""
    total = np.zeros(len(docs))

    def add(held: list[tuple[np.ndarray, ...]]) -> None:
        doc, y, states = (np.concatenate(x, axis=-1) for x in zip(*held))
        total[:] += np.bincount(doc, outputs(net, states, y), len(docs))

    packed_lanes = lanes_of(docs, lanes)
    h = np.zeros((len(packed_lanes), net["W"].shape[0]), net["b"].dtype)
    held, n = [], 0
    with np.errstate(over="ignore"):
        for w in windows(packed_lanes, steps):
            h, states, _ = run_window(net, h[: w.runs[0]], w)
            held.append((w.flat(w.doc), w.flat(w.y), states))
            n += w.steps[-1]
            if n >= BATCH:
                add(held)
                held, n = [], 0
        if held:
            add(held)
    return total


def dump(net: dict) -> bytes:
    f = io.BytesIO()
    np.savez(f, **net)
    return f.getvalue()


def load(blob: bytes) -> dict:
    z = np.load(io.BytesIO(blob))
    return {k: z[k] for k in z.files}


# ---------------------------------------------------------------- on Spark

def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, c): occurrences of every word and of the end."""
    def per_batch(batches: Batches) -> Batches:
        for b in batches:
            keys, word, _ = words_of(b.column(0))
            n = np.bincount(word, minlength=len(keys))
            keys, n = pa.concat_arrays([keys.filter(pa.array(n > 0)), pa.array([END_KEY])]), np.append(n[n > 0], b.num_rows)
            yield record(pa.schema([("key", pa.string()), ("c", pa.int64())]), (keys, n))

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(per_batch, "key string, c long")
    return found.groupBy("key").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """(key, c) of at most ``most`` keys, in falling order: all from the lowest
    level of counts (sixteenths of a power of two) that keeps within it.
    Levels are counted first, so no task sends more than its share of these."""
    level = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    kept, least = 0, None
    for k, n in sizes:
        if kept + n > most:
            break
        kept, least = kept + n, k
    if least is None:
        return []
    return sorted(((r.key, r.c) for r in counts.filter(level >= least).collect()), key=lambda x: (-x[1], x[0]))


def vocabulary_size(found: list[int]) -> int:
    """Words of the model, the end and unknown tokens among them, from the words' counts in falling order."""
    return max(LEAST_WORDS, min(MOST_WORDS, sum(c >= OFTEN for c in found) + 2))


def average(parts: DataFrame) -> dict | None:
    """Token-weighted mean of the parameters in (part, tokens, net), in a tree."""
    def mean(pdf):
        total = float(pdf["tokens"].sum())
        net: dict[str, np.ndarray] = {}
        for n, blob in zip(pdf["tokens"], pdf["net"]):
            for k, v in load(blob).items():
                net[k] = net.get(k, 0) + v.astype(np.float64) * (n / total)
        return pdf.iloc[:1][["part"]].assign(tokens=int(total), net=[dump({k: v.astype(np.float32) for k, v in net.items()})])

    while (most := parts.agg(F.max("part")).first()[0]) is not None and most > 0:
        above = parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = stage(above.groupBy("part").applyInPandas(mean, "part long, tokens long, net binary"), "lm-parts")
    one = parts.first()
    return load(one.net) if one else None


def fit(encoded: DataFrame, net: dict, rounds: int = ROUNDS) -> dict:
    """``net`` trained on the rows of ``encoded`` (ids, part); each row in one round."""
    for k in range(rounds):
        blob = dump(net)

        def per_partition(batches: Batches) -> Batches:
            own = load(blob)
            opt, seen = Adam(own), 0
            for b in batches:
                docs = [np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()]
                seen += train(own, opt, docs)
            if seen:
                from pyspark import TaskContext
                yield record(pa.schema([("part", pa.int64()), ("tokens", pa.int64()), ("net", pa.binary())]),
                             ([TaskContext.get().partitionId()], [seen], [dump(own)]))

        rows = encoded.filter(F.col("part") == k).select("ids")
        net = average(stage(rows.mapInArrow(per_partition, "part long, tokens long, net binary"), "lm-parts")) or net
    return net


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD,
          vocabulary: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Base and model scores of every row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10).

    ``vocabulary`` grows with the counted words unless given.
    ``held_out`` (a condition on the columns of ``docs``; null counts as
    false) keeps rows out of all counts and training.  Null and empty texts
    are the end token alone; repeated rows count and score each; without
    training rows all counts are 0 and the model is its even start; words
    of equal counts are ordered by themselves; very long texts are scored
    whole; other columns, whatever their names, play no part; an empty table
    gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stage(count_words(own.filter(~F.col("held_out")), "text"), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts.filter(F.col("key") != END_KEY), head)
    ends = sum(r.c for r in counts.filter(F.col("key") == END_KEY).collect())
    known = top[: (vocabulary or vocabulary_size([c for _, c in top])) - 2]
    inside = ends + sum(c for _, c in known)
    rest, rest_distinct = total - inside, distinct - len(known) - (1 if ends else 0)
    # log10 shares: of any token, and of an unknown word among unknown words
    floor, rest_floor = np.log10(total + distinct + 1), np.log10(rest + rest_distinct + 1)
    net = new_net(np.array([ends, rest, *(c for _, c in known)], np.float64))

    head_keys = pa.array([k for k, _ in top], pa.string())
    head_log = np.log10(np.array([c for _, c in top] + [0], np.float64) + 1)
    end_log = float(np.log10(ends + 1) - floor)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), *T._parse_datatype_string(
        "held_out boolean, ids binary, n_tokens long, head_known long, head_base double, head_rest double, tail array<string>, tail_n array<long>").fields]
    n_known_ids = len(known)

    def per_batch(batches: Batches) -> Batches:
        for b in (whole.slice(first, ROWS) for whole in batches for first in range(0, whole.num_rows, ROWS)):
            keys, word, sizes = words_of(b.column(1))
            place = pc.fill_null(pc.index_in(keys, value_set=head_keys), -1).to_numpy()
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            ids = np.full(len(word) + len(sizes), END, "<u2")
            ids[np.arange(len(word)) + doc] = np.where((place >= 0) & (place < n_known_ids), place + 2, UNKNOWN).astype("<u2")[word]

            def per_doc(of_key: np.ndarray) -> np.ndarray:
                return np.bincount(doc, of_key[word], len(sizes))

            inside, beyond = place >= 0, place >= n_known_ids
            n_inside, n_beyond = per_doc(inside), per_doc(beyond)
            base = per_doc(np.where(inside, head_log[place], 0)) - n_inside * floor + end_log
            rest_base = per_doc(np.where(beyond, head_log[place], 0)) - n_beyond * rest_floor
            outside = np.flatnonzero(~inside[word])
            pairs, n = np.unique(doc[outside] * np.int64(len(keys)) + word[outside], return_counts=True)
            of_doc, of_key = np.divmod(pairs, max(1, len(keys)))
            starts = pa.array(np.searchsorted(of_doc, np.arange(len(sizes) + 1)), pa.int32())
            ends_at = np.append(0, 2 * np.cumsum(sizes + 1)).astype(np.int32)
            cols = (pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends_at), pa.py_buffer(ids)]),
                    pa.array(sizes + 1, pa.int64()), pa.array(n_inside.astype(np.int64) + bool(ends)), pa.array(base), pa.array(rest_base),
                    pa.ListArray.from_arrays(starts, keys.take(pa.array(of_key))), pa.ListArray.from_arrays(starts, pa.array(n, pa.int64())))
            schema = pa.schema([(f.name, c.type) for f, c in zip(fields, (b.column(0), b.column(2), *cols), strict=True)])
            yield record(schema, (b.column(0), b.column(2), *cols))

    encoded = own.mapInArrow(per_batch, T.StructType(fields)).withColumn("uid", F.monotonically_increasing_id())
    encoded = stage(encoded.withColumn("part", F.pmod(F.xxhash64("ids", "uid"), F.lit(rounds))), "lm-encoded")
    net = fit(encoded.filter(~F.col("held_out")), net, rounds)
    blob = dump(net)

    def likelihood(batches: Batches) -> Batches:
        trained = load(blob)
        for b in batches:
            ll = log_likelihood(trained, [np.frombuffer(x, "<u2") for x in b.column(1).to_pylist()])
            yield record(pa.schema([("uid", pa.int64()), ("ll", pa.float64()), *((f.name, b.column(i + 2).type) for i, f in enumerate(carried))]),
                         (b.column(0), ll / np.log(10), *b.columns[2:]))

    carried = [f for f in encoded.schema if f.name in ("doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_rest")]
    lm = encoded.select("uid", "ids", *(f.name for f in carried)).mapInArrow(
        likelihood, T.StructType([T.StructField("uid", T.LongType()), T.StructField("ll", T.DoubleType()), *carried]))
    tails = (encoded.filter(F.size("tail") > 0).select("uid", F.explode(F.arrays_zip("tail", "tail_n")).alias("x"))
             .select("uid", F.col("x.tail").alias("key"), F.col("x.tail_n").alias("n")))
    c = F.coalesce("c", F.lit(0))
    per_doc = (tails.join(counts, "key", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * (F.log10(c + 1) - float(floor))).alias("tail_base"),
        F.sum(F.col("n") * (F.log10(c + 1) - float(rest_floor))).alias("tail_rest")))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return lm.join(per_doc, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("head_base") + zero("tail_base")).alias("base_score"),
        (F.col("ll") + F.col("head_rest") + zero("tail_rest")).alias("score"))
