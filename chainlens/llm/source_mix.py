"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives every document posterior
probabilities over domains; documents then get nonnegative rates whose
expected domain token totals match the targets in the least-squares sense,
found by projected gradient descent over all documents.

DataFrame functions only.  The classifier is naive Bayes over hashed words
and a few shape features: its counts are one grouped aggregate, its
weights literal arrays of ``BUCKETS`` small numbers, so that scoring is a
fold over a text's words inside a projection, with no join and no shuffle.
Weights are log ratios that shrink smoothly with the deviation they rest on.
A logistic calibration turns their sums into posteriors; it is fitted on
labelled rows scored by the weights of the other folds, so that a text
without evidence for a domain is evidence against it, as far as such texts
are rarely of that domain.

With p[d, k] the posteriors, w[d] the tokens and b[k] the targets, the
objective is the squared relative misfit of sum_d r[d] w[d] p[d, k]
against b[k], with a small pull of r towards 1.  In the token-weighted
metric a gradient step is r[d] <- max(0, r[d] - sum_k p[d, k] e[k] - pull),
taken with Nesterov's momentum, with e[k] the relative misfit of domain k: all that an iteration needs
from the corpus is one number per domain, an aggregate over a staged table
of (tokens, posteriors).  The rates of an iteration are a fold over the
misfits so far and are never stored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import stage

BUCKETS = 1 << 16
#: Labelled rows the classifier learns from at most, the first by a hash of their id.
MAX_LABELLED = 20_000
#: Weights are kept in steps of 1 / UNIT.
UNIT = 64
#: A weight is half its log ratio at this many standard deviations, with this steepness.
HALF_Z, STEEP = 6.0, 6
#: Labelled rows are scored by weights learned without their own fold.
FOLDS = 4
#: Bound of a text's summed weights.
MOST_EVIDENCE = 40.0
PULL, ITERATIONS, TOLERANCE = 1e-3, 24, 1e-5


def words_of(text: Column) -> Column:
    """Words in lower case; none for null and blank texts."""
    low = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, r"[\x20\x09-\x0D]+"))


def _level(share: Column) -> Column:
    return F.floor(F.log2(1 + 256 * share)).cast("string")


def marks(text: Column, words: Column) -> Column:
    """Shape marks of a text: levels of symbols, capitals, repeated words."""
    text = F.coalesce(text, F.lit(""))
    share = lambda s: F.char_length(F.regexp_replace(text, f"[^{s}]+", "")) / (F.char_length(text) + 1)
    return F.array(F.concat(F.lit("\x01symbols "), _level(share("#*$%&|<>!"))),
                   F.concat(F.lit("\x01capitals "), _level(share("A-Z"))),
                   F.concat(F.lit("\x01repeats "), _level(1 - F.size(F.array_distinct(words)) / (F.size(words) + 1))))


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def with_buckets(docs: DataFrame, text: Column, buckets: int, *carry: Column) -> DataFrame:
    """The carried columns, tokens, and the distinct buckets of the text's words
    and marks (a word that one text repeats is evidence once).  Step by step, so that each is computed once per row."""
    own = docs.select(F.struct(*carry).alias("c"), text.alias("t"), words_of(text).alias("ws"))
    own = own.select("c", F.size("ws").cast("long").alias("tokens"), F.concat("ws", marks(F.col("t"), F.col("ws"))).alias("fs"))
    return own.select("c.*", "tokens", F.array_distinct(F.transform("fs", lambda w: bucket(w, buckets))).alias("bs"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str,
          max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS) -> dict:
    """Naive Bayes weights against the first domain, per other domain {bucket:
    weight}, and the calibration of their sums: ``prior`` (log odds without
    evidence) and ``scale`` (a row of factors per other domain)."""
    rows = labelled.select(F.col(id_col).alias("label_id"), F.col("domain").alias("label_domain")).filter(F.col("label_domain").isin(domains))
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id", "label_domain").limit(max_labelled)
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("t")).join(F.broadcast(rows), "label_id")
    words = with_buckets(own, F.col("t"), buckets, F.col("label_domain"))
    # copies of a text share a fold
    words = stage(words.select("label_domain", "bs", F.pmod(F.xxhash64("bs"), F.lit(FOLDS)).cast("int").alias("fold"),
                               F.monotonically_increasing_id().alias("uid")), "mix-labelled")  # bounded by max_labelled
    sizes = {(r[0], r[1]): r[2] for r in words.groupBy("label_domain", "fold").agg(F.count("*")).collect()}
    counts = (words.select("label_domain", "fold", F.explode("bs").alias("b")).groupBy("b").agg(
        *(F.sum(((F.col("label_domain") == d) & (F.col("fold") == f)).cast("long")).alias(f"n{k}_{f}")
          for k, d in enumerate(domains) for f in range(FOLDS))))

    def weight(k: int, folds: list[int]) -> Column:
        n_docs = [sum(sizes.get((d, f), 0) for f in folds) for d in domains]
        held = [sum((F.col(f"n{j}_{f}") for f in folds), F.lit(0)) for j in range(len(domains))]
        share = (n_docs[k] + 1) / (sum(n_docs) + 1 + len(domains))
        expected = sum(held, F.lit(0)) * share
        z = F.abs(held[k] - expected) / F.sqrt(expected * (1 - share) + 0.25)
        ratio = F.log((held[k] + 0.5) / (n_docs[k] + 1.0)) - F.log((held[0] + 0.5) / (n_docs[0] + 1.0))
        there = F.pow(z / HALF_Z, F.lit(STEEP))
        return F.round(ratio * there / (1 + there) * UNIT) / UNIT

    others, every = range(1, len(domains)), list(range(FOLDS))
    table = stage(counts.select("b", *(weight(k, every).alias(f"w{k}") for k in others), *(
        F.array(*(weight(k, [g for g in every if g != f]) for f in every)).alias(f"x{k}") for k in others)), "mix-weights")  # at most ``buckets`` rows
    crossed = (words.select("uid", "label_domain", "fold", F.explode("bs").alias("b")).join(F.broadcast(table), "b")
               .groupBy("uid", "label_domain").agg(*(F.sum(F.get(f"x{k}", F.col("fold"))).alias(f"s{k}") for k in others)).collect())  # bounded by max_labelled
    scores = np.array([[r[f"s{k}"] for k in others] for r in crossed]).reshape(len(crossed), len(others))
    prior, scale = calibrate(scores, np.array([domains.index(r["label_domain"]) for r in crossed], int), len(domains))
    rows = table.select("b", *(f"w{k}" for k in others)).filter(" OR ".join(f"w{k} <> 0" for k in others)).collect()  # at most ``buckets`` rows
    return {"prior": prior, "scale": scale, "weights": [{r["b"]: r[f"w{k}"] for r in rows if r[f"w{k}"]} for k in others], "buckets": buckets}


def calibrate(scores: np.ndarray, domain: np.ndarray, n: int, ridge: float = 1.0, few: float = 0.1) -> tuple[list[float], list[list[float]]]:
    """Multinomial logistic fit of the domain on the scores by Newton steps:
    log odds against the first domain, as intercepts and factors.  Each
    domain counts as seen ``few`` times more without evidence, so that one without labels has odds."""
    x = np.concatenate([np.ones((len(scores), 1)), np.clip(scores, -MOST_EVIDENCE, MOST_EVIDENCE)], 1)
    x = np.concatenate([x, np.eye(x.shape[1])[[0] * n]])
    y, weight = np.eye(n)[np.append(domain, range(n))], np.append(np.ones(len(domain)), [few] * n)[:, None]
    d = x.shape[1]
    w, pull = np.zeros((d, n)), np.full((d, 1), ridge)
    pull[0] = 1e-6
    for _ in range(100):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (weight * (p - y)) + pull * w
        h = np.einsum("ia,ij,ik,ib->jakb", x, weight * p, -p, x, optimize=True)
        for k in range(n):
            h[k, :, k] += x.T @ (weight * p[:, k:k + 1] * x) + np.diag(pull[:, 0] + 1e-3)
        step = np.linalg.solve(h.reshape(n * d, n * d), g.T.ravel()).reshape(n, d).T
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    w = w - w[:, :1]
    return [float(v) for v in w[0, 1:]], [[float(v) for v in w[1:, k]] for k in range(1, n)]


def _adder(table: Column):
    return lambda acc, b: acc + F.get(table, b)


def evidence(buckets: Column, model: dict) -> Column:
    """Struct of the other domains' weights summed over a text's buckets, in ``1 / UNIT``."""
    sums = []
    for k, w in enumerate(model["weights"]):
        flat = ["0"] * model["buckets"]
        for b, x in w.items():
            flat[b] = str(max(-32767, min(32767, round(x * UNIT))))
        table = F.split(F.lit(",".join(flat)), ",").cast("array<smallint>")  # folded into one literal
        sums.append(F.aggregate(buckets, F.lit(0).cast("long"), _adder(table)).alias(f"s{k}"))
    return F.struct(*sums)


def members(docs: DataFrame, model: dict, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """row (the carried columns), tokens, p0.. (posteriors, the first domain first) and u, a hash in [0, 1).

    Written once: what follows is arithmetic on these columns, and the
    texts are not read again."""
    text, n = F.col(text_col), len(model["prior"]) + 1
    u = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / float(1 << 30)
    scored = with_buckets(docs, text, model["buckets"], F.struct(*carry).alias("row"), u.alias("u"))
    scored = scored.select("row", "tokens", "u", evidence(F.col("bs"), model).alias("s"))
    bounded = lambda x, most: F.greatest(F.lit(-most), F.least(F.lit(most), x))
    scored = scored.select("row", "tokens", "u", *(bounded(F.col(f"s.s{k}") / float(UNIT), MOST_EVIDENCE).alias(f"s{k}") for k in range(n - 1)))
    odds = [F.lit(1.0)] + [F.exp(bounded(sum((F.col(f"s{j}") * a for j, a in enumerate(scale)), F.lit(p)), 30.0))
                           for p, scale in zip(model["prior"], model["scale"], strict=True)]
    scored = scored.select("row", "tokens", "u", F.array(*odds).alias("odds"))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return stage(scored.select("row", "tokens", "u", F.transform("odds", lambda o: o / total).alias("p"))
                 .select("row", "tokens", "u", *(F.col("p")[k].alias(f"p{k}") for k in range(n))), "mix-members")


def fit_rates(rows: DataFrame, n: int, targets: list[float] | None, shares: list[float] | None = None,
              iterations: int = ITERATIONS, pull: float = PULL, most: float | None = None) -> list[list[float]]:
    """Misfits of each iteration, from (tokens, p0..pn-1); ``rates`` turns them into rates.

    ``targets`` are domain token totals; ``shares`` give them as shares of
    all tokens instead."""
    sums = rows.agg(*(F.sum(F.col("tokens") * F.col(f"p{k}")) for k in range(n))).first()
    base = [float(x or 0.0) for x in sums]
    want = targets if targets is not None else [s * sum(base) / sum(shares) for s in shares]
    steps: list[list[float]] = []
    for _ in range(iterations):
        weighed = rows.withColumn("w", F.col("tokens") * ahead(steps, n, pull, most))
        got = weighed.agg(*(F.sum(F.col("w") * F.col(f"p{k}")) for k in range(n))).first()
        e = [((float(g or 0.0) - t) / b if b > 0 else 0.0) for g, t, b in zip(got, want, base, strict=True)]
        if steps and max(abs(x - y) for x, y in zip(e, steps[-1], strict=True)) < TOLERANCE:
            break
        steps.append(e)
    return steps


def momentum(t: int) -> float:
    return max(0.0, (t - 1) / (t + 2))


def _path(steps: list[list[float]], n: int, pull: float, most: float | None) -> Column:
    """(r, before): the rates after the last step and the one before it, a fold over the steps' misfits."""
    one = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))
    if not steps:
        return one

    def step(s: Column, e: Column) -> Column:
        y = s["r"] + F.get(e, F.lit(n)) * (s["r"] - s["before"])
        pulled = (1 - pull) * y + pull
        r = pulled - sum((F.col(f"p{k}") * F.get(e, F.lit(k)) for k in range(1, n)), F.col("p0") * F.get(e, F.lit(0)))
        r = F.greatest(F.lit(0.0), r)
        return F.struct((r if most is None else F.least(F.lit(most), r)).alias("r"), s["r"].alias("before"))

    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in [*e, momentum(t)])) for t, e in enumerate(steps))), one, step)


def ahead(steps: list[list[float]], n: int, pull: float = PULL, most: float | None = None) -> Column:
    """Where the next gradient is taken: the rate moved on by the momentum."""
    s = _path(steps, n, pull, most)
    return s["r"] + momentum(len(steps)) * (s["r"] - s["before"])


def rates(steps: list[list[float]], n: int, pull: float = PULL, most: float | None = None) -> Column:
    return _path(steps, n, pull, most)["r"]


def mix(docs: DataFrame, labelled: DataFrame, shares: dict[str, float] | None = None, keep: dict[str, float] | None = None,
        id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), nearest: bool = False,
        without: tuple[str, ...] = (), most: float | None = None, **limits) -> DataFrame:
    """Rates for every row of ``docs``: row (the carried columns), tokens, p0.. in the order of the domains, rate, copies.

    ``labelled`` has the id column and ``domain``.  Targets per domain are
    ``shares`` of all tokens, or ``keep`` times the domain's own expected
    tokens, those of documents that speak for a domain in ``without`` left
    out (the domain whose posterior is the largest multiple of its mean over
    all rows): memberships are soft, so the documents that stay hold some
    expected tokens of these domains too, and a target of nothing could not
    be met.
    Rates are at most ``most``, if given; a rate of 1 at most makes no copies.
    copies is the rate rounded so that its expectation is the rate (by a hash
    of id and text), or to the nearest whole with ``nearest``.  Of equal
    multiples the first domain counts; very long texts are read
    whole; columns of ``docs`` are carried in a struct, so no name clashes.
    Null and empty texts have no tokens and get the prior's posteriors; ids
    do not take part beyond the hash, so nulls and repeats are rows like any
    other; without labels all posteriors are even; an empty table gives an
    empty result.
    """
    domains = list(shares or keep)
    n = len(domains)
    full = members(docs, learn(docs, labelled, domains, id_col, text_col, **limits), id_col, text_col, carry)
    if keep:
        p = [F.col(f"p{k}") for k in range(n)]
        stays = F.lit(True)
        if without:
            mean = full.agg(*(F.avg(x) for x in p)).first()
            times = [x / F.lit(max(float(m or 0), 1e-9)) for x, m in zip(p, mean, strict=True)]
            stays = ~(F.array_position(F.array(*times), F.greatest(*times)) - 1).isin([domains.index(d) for d in without])
        own = full.agg(*(F.sum(F.when(stays, F.col("tokens") * x)) for x in p)).first()
        steps = fit_rates(full, n, [float(o or 0) * keep[d] for o, d in zip(own, domains, strict=True)], most=most)
    else:
        steps = fit_rates(full, n, None, [shares[d] for d in domains], most=most)
    u = F.lit(0.5) if nearest else F.col("u")
    return full.withColumn("rate", rates(steps, n, most=most)).withColumn("copies", F.floor(F.col("rate") + u).cast("long"))


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from the 0/1 labels: toxic, else good or poor by quality; rows without labels go."""
    d = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(id_col, d.alias("domain")).filter("domain IS NOT NULL")
