"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text; the hash of each candidate's value
is counted over the corpus by distinct repositories and owners.  A value
that many owners hold, or very many repositories of few owners, is a widely
copied example; one that stays with few of both and looks random is taken
for a live credential.  Both verdicts are added as spans beside the candidates' own.

DataFrame functions only.  Positions come from the text's pieces between
matches: piece and match lengths, summed in order per document, give the
offsets in code points.  Texts without a candidate leave after one regular
expression; of the others only matches and lengths are written to the
shared folder.  Ownership is counted in stages (value, owner, repository;
then value, owner; then value), each combined before its shuffle, so a
value that a third of the corpus repeats is never gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import stage


@dataclass(frozen=True)
class Kind:
    """``group`` holds the value, which ends the match; shorter values than ``least`` are no match."""
    name: str
    pattern: str
    group: int
    least: int


BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]+", 0, 24),
)
#: Cheap tests that every text with a match of the kind passes.
HINTS = (BASE[0].pattern, r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")

#: A value of at least this many owners, or of this many repositories whatever their owners, is a copied example ...
COPIED_OWNERS, COPIED_REPOS = 3, 100
#: ... and one of fewer looks live with this many characters, distinct ones, and both digits and letters.
LIVE_CHARS, LIVE_DISTINCT = 12, 6


def _found(text: Column, kind: Kind) -> Column:
    """Every raw match of a kind: number, length of the piece before it, length, value."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    pieces = F.split(text, kind.pattern, -1)
    return F.transform(
        F.arrays_zip(pieces.alias("p"), hits.alias("h"), values.alias("v")),
        lambda x, i: F.struct(F.lit(kind.name).alias("kind"), i.alias("i"), F.char_length(x["p"]).alias("gap"),
                              F.char_length(x["h"]).alias("len"), x["v"].alias("value")))


def candidates(docs: DataFrame, repo_col: str, owner_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """One row per row of ``docs``: uid, repo, owner, the carried columns and the raw matches."""
    text = F.coalesce(text_col, F.lit(""))
    per_kind = [F.when(text.rlike(hint), F.filter(_found(text, k), lambda x: x["len"].isNotNull())) for k, hint in zip(BASE, HINTS, strict=True)]
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,value:string>>")
    return docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"),
        *(F.col(c).alias(f"c{n}") for n, c in enumerate(carry)),
        F.concat(*(F.coalesce(f, empty) for f in per_kind)).alias("found"))


def spans_of(staged: DataFrame) -> DataFrame:
    """(uid, repo, owner, kind, start, stop, value, at): matches that pass, ``at`` where the value starts."""
    rows = staged.filter(F.size("found") > 0).select("uid", "repo", "owner", F.explode("found").alias("x")).select("uid", "repo", "owner", "x.*")
    before = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.create_map(*(F.lit(x) for k in BASE for x in (k.name, k.least)))
    return (rows.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(before))
            .withColumn("start", F.col("stop") - F.col("len")).withColumn("at", F.col("stop") - F.char_length("value"))
            .filter(F.char_length("value") >= least[F.col("kind")])
            .select("uid", "repo", "owner", "kind", "start", "stop", "value", "at", F.sha2("value", 256).alias("h")))


def ownership(spans: DataFrame) -> DataFrame:
    """(h, n_repos, n_owners): distinct repositories and owners of each value."""
    per_repo = spans.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("h").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def looks_live(value: Column) -> Column:
    return ((F.char_length(value) >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT))


def scan(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text",
         carry: tuple[str, ...] = ("doc_id",), copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """The carried columns with ``spans``, an array of (start, rank, stop, kind, n_repos, n_owners) sorted.

    Base kinds are assign, access and hex; ``copied`` and ``live`` spans
    cover the values of base matches with that verdict, once per place.
    Null and empty texts have no spans; a null owner or repository is one
    like any other; repeated rows each keep their spans and count as one
    repository; an empty table gives an empty result.
    """
    staged = stage(candidates(docs, repo_col, owner_col, text_col, carry), "secret-candidates")
    spans = stage(spans_of(staged), "secret-spans")
    known = spans.join(ownership(spans), "h")
    is_copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    verdict = F.when(is_copied, F.lit("copied")).when(looks_live(F.col("value")), F.lit("live"))
    rank = {k: n for n, k in enumerate([k.name for k in BASE] + ["copied", "live"])}
    ranks = F.create_map(*(F.lit(x) for k in rank.items() for x in k))

    def as_span(start: Column, kind: Column) -> Column:
        return F.struct(start.alias("start"), ranks[kind].alias("rank"), F.col("stop"), kind.alias("kind"), "n_repos", "n_owners")

    both = F.array(as_span(F.col("start"), F.col("kind")), F.when(verdict.isNotNull(), as_span(F.col("at"), verdict)))
    per_doc = (known.select("uid", F.explode(F.filter(both, lambda s: s.isNotNull())).alias("s")).distinct()
               .groupBy("uid").agg(F.sort_array(F.collect_list("s")).alias("spans")))
    kind = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,n_repos:bigint,n_owners:bigint>>"
    return (staged.join(per_doc, "uid", "left")
            .select(*(F.col(f"c{n}").alias(c) for n, c in enumerate(carry)), F.coalesce("spans", F.array().cast(kind)).alias("spans")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
