"""Sequences, intervals, frames, ranks, sketches and differences against brute force; hot wallets in slices."""
import datetime as dt
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from core_helpers import SF001, SF01, tx_rows

import __spark_entry__ as E
from chainlens.functions.slices import hot_slices, ranked, with_slice
from chainlens.operators import differences as D
from chainlens.operators import incremental_features as INC
from chainlens.operators import intervals as IV
from chainlens.operators import props as PR
from chainlens.operators import ranks as RK
from chainlens.operators import rolling as RO
from chainlens.operators import sequences as S
from chainlens.operators import sketches as SK
from chainlens.operators import wallets as W
from chainlens.plans import catalog

START = dt.datetime(2025, 1, 1)
CHAINS = ["base", "bsc", "zora"]
SMALL = 40  # rows of a slice: the hot wallet has many


def rows_with_a_hot_wallet(n=600, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        wallet = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"w{r.randint(0, 25)}"
        # half of the hot wallet's rows fall into one hour: cells of one slice
        minutes = r.randint(0, 60) if wallet == "hot" and i % 2 else r.randint(0, 120 * 24 * 60)
        out.append({"wallet": wallet, "created_at": None if i % 61 == 2 else START + dt.timedelta(minutes=minutes // 5 * 5),
                    "origin_chain_name": r.choice(CHAINS), "destination_chain_name": r.choice([*CHAINS, None]),
                    "execution_kind": r.choice(["Bridge", "Cross chain swap", "Other"]), "deposit_tx_hash": f"d{r.randint(0, n)}",
                    "user_send_currency": r.choice(["USDC", "ETH"]), "user_receive_currency": r.choice(["USDC", None]),
                    "user_send_currency_usd": r.choice([None, 0.1, 2.25, 1000.0]), "user_receive_currency_usd": 1.5,
                    "is_call": r.choice([True, False, None]), "route_source": r.choice(["api", None])})
    return out


@pytest.fixture(scope="module")
def rows():
    return rows_with_a_hot_wallet()


@pytest.fixture(scope="module")
def tx(spark, rows):
    return tx_rows(spark, rows).repartition(5).cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------ slices

def test_slices_bound_a_hot_wallet_and_keep_its_order(tx):
    hot = hot_slices(tx, ["wallet"], "created_at", SMALL)
    assert [r._kwallet for r in hot.collect()] == ["hot"]
    cut = with_slice(tx, hot, ["wallet"], "created_at")
    assert cut.count() == tx.count() and cut.where("_hot").select("wallet").distinct().count() == 1
    spans = cut.where("_hot and created_at is not null").groupBy("_slice").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"),
                                                                              F.count("*").alias("n")).orderBy("_slice").collect()
    assert len(spans) >= 3 and all(x.b < y.a for x, y in zip(spans, spans[1:]))
    # one cell is the least that can be cut: two hours of the 120 days here
    assert max(s.n for s in spans) <= SMALL + 110
    assert hot_slices(tx, ["wallet"], "created_at", 10_000) is None


@pytest.mark.parametrize("slice_rows", [SMALL, 10_000])
def test_ranked_numbers_across_slices(tx, rows, slice_rows):
    got = ranked(tx, ["wallet"], "created_at", ["deposit_tx_hash", "origin_chain_name"], "n", slice_rows)
    by = defaultdict(list)
    for r in got.collect():
        by[r.wallet].append((r.n, r.created_at or dt.datetime.min, r.deposit_tx_hash, r.origin_chain_name))
    assert sum(map(len, by.values())) == len(rows) and None in by
    for found in by.values():
        assert [x[0] for x in sorted(found)] == list(range(1, len(found) + 1))
        assert [x[1:] for x in sorted(found)] == sorted(x[1:] for x in found)


# ------------------------------------------------------------ as-of join

@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("slice_rows", [SMALL, 10_000])
def test_as_of_join(tx, rows, strict, slice_rows):
    left = tx.where("execution_kind = 'Bridge'").select("wallet", "created_at", "deposit_tx_hash")
    right = tx.where("execution_kind <> 'Bridge'")
    take = ["created_at", "origin_chain_name", "user_send_currency_usd"]
    got = S.as_of(left, right, "wallet", "created_at", take, strict=strict, slice_rows=slice_rows)
    low = (dt.datetime.min, "", -1.0)
    key = lambda x: tuple(low[i] if v is None else v for i, v in enumerate(x))
    others = defaultdict(list)
    for r in rows:
        if r["execution_kind"] != "Bridge" and r["wallet"] is not None and r["created_at"] is not None:
            others[r["wallet"]].append(tuple(r[c] for c in take))
    want = Counter()
    for r in rows:
        if r["execution_kind"] == "Bridge":
            t = r["created_at"]
            seen = [o for o in others[r["wallet"]] if t is not None and (o[0] < t or not strict and o[0] == t)]
            want[(r["wallet"], t, r["deposit_tx_hash"], *(max(seen, key=key) if seen else (None,) * 3))] += 1
    assert Counter(tuple(x) for x in got.collect()) == want
    assert got.columns == ["wallet", "created_at", "deposit_tx_hash", "prev_created_at", "prev_origin_chain_name", "prev_user_send_currency_usd"]


def test_last_value_is_carried_over_slices_without_any(spark):
    """The only earlier row lies many slices before."""
    t = [START + dt.timedelta(hours=i) for i in range(500)]
    left = spark.createDataFrame([("hot", x, i) for i, x in enumerate(t[1:])], "wallet string, at timestamp, i int")
    right = spark.createDataFrame([("hot", t[0], "first")], "wallet string, at timestamp, what string")
    got = S.as_of(left, right, "wallet", "at", ["what"], slice_rows=20)
    assert got.where("prev_what = 'first'").count() == 499


def test_as_of_walks_both_sides_once(spark, tx):
    plan = plan_of(S.bridge_after_swap(tx))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning(_by") == 1
    assert S.bridge_after_swap(tx.limit(0)).count() == 0


# ------------------------------------------------------------ return trips

@pytest.mark.parametrize("slice_rows", [SMALL, 10_000])
def test_return_trips_match_first_in_first_out(tx, rows, slice_rows):
    got = S.return_trips(tx, slice_rows)
    queues, want = defaultdict(list), Counter()
    order = lambda r: (r["created_at"], r["origin_chain_name"], r["deposit_tx_hash"], -1 if r["user_send_currency_usd"] is None else r["user_send_currency_usd"])
    moves = [r for r in rows if r["wallet"] and r["created_at"] and r["destination_chain_name"] and r["origin_chain_name"] != r["destination_chain_name"]]
    for r in sorted(moves, key=order):
        w, o, d = r["wallet"], r["origin_chain_name"], r["destination_chain_name"]
        if queues[w, d, o]:  # an unused way out waits for this way back
            out = queues[w, d, o].pop(0)
            want[(w, d, o, out["created_at"], r["created_at"], (r["created_at"] - out["created_at"]) / dt.timedelta(days=1))] += 1
        else:
            queues[w, o, d].append(r)
    assert Counter((r.wallet, r.chain_a, r.chain_b, r.out_time, r.back_time, r.days_away) for r in got.collect()) == want
    assert sum(want.values()) > 50 and any(w[0] == "hot" for w in want)
    routes = S.trip_routes(got).collect()
    assert sum(r.trips for r in routes) == sum(want.values())


# ------------------------------------------------------------ sessions

@pytest.mark.parametrize("slice_rows", [SMALL, 10_000])
@pytest.mark.parametrize("gap", [0.02, 0.5, 2.0, 40.0])
def test_sessions(tx, rows, slice_rows, gap):
    times = defaultdict(list)
    for r in rows:
        if r["wallet"] and r["created_at"]:
            times[r["wallet"]].append((r["created_at"], r["user_send_currency_usd"]))
    want = []
    for w, found in times.items():
        found.sort(key=lambda x: x[0])
        for i, (t, usd) in enumerate(found):
            if i == 0 or t - found[i - 1][0] > dt.timedelta(days=gap):
                want.append([w, t, t, 0, None])
            s = want[-1]
            s[2], s[3] = t, s[3] + 1
            s[4] = s[4] if usd is None else round((s[4] or 0) + usd, 8)
    got = S.sessions(tx, gap, slice_rows)
    assert sorted((r.wallet, r.session_start, r.session_end, r.n_tx, r.volume_usd) for r in got.collect()) == sorted(map(tuple, want))
    per_wallet = {r.wallet: r for r in S.session_summary(got).collect()}
    assert per_wallet["hot"].n_sessions == sum(w[0] == "hot" for w in want)


# ------------------------------------------------------------ intervals

def test_points_in_intervals(spark, tx, rows):
    r = random.Random(1)
    spans = []
    for i in range(60):
        a = START + dt.timedelta(minutes=5 * r.randint(-500, 40_000))
        b = a + dt.timedelta(minutes=5 * r.choice([0, 1, 3, 300, 20_000, -10]))
        spans.append((r.choice(CHAINS), i, a, None if i % 20 == 7 else b))
    intervals = spark.createDataFrame(spans, "origin_chain_name string, no int, starts timestamp, ends timestamp")
    got = IV.points_in_intervals(tx.select("wallet", "created_at", "origin_chain_name", "deposit_tx_hash"), intervals, "created_at", "starts", "ends",
                                 ["origin_chain_name"])
    want = Counter((x["deposit_tx_hash"], x["created_at"], no) for x in rows for c, no, a, b in spans
                   if x["created_at"] and b and c == x["origin_chain_name"] and a <= x["created_at"] < b)
    assert Counter((x.deposit_tx_hash, x.created_at, x.no) for x in got.collect()) == want and sum(want.values()) > 500
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlapping_intervals(spark):
    r = random.Random(2)

    def some(n, prefix):
        out = []
        for i in range(n):
            a = START + dt.timedelta(hours=r.randint(0, 2000))
            out.append((f"{prefix}{i}", a, a + dt.timedelta(hours=r.choice([0, 1, 24, 25, 700]))))
        return out

    a, b = some(80, "a"), some(80, "b")
    got = IV.overlapping_intervals(spark.createDataFrame(a, "x string, xs timestamp, xe timestamp"),
                                   spark.createDataFrame(b, "y string, ys timestamp, ye timestamp"), ("xs", "xe"), ("ys", "ye"))
    want = Counter((x, y) for x, s, e in a for y, u, v in b if s < e and u < v and s < v and u < e)
    assert Counter((q.x, q.y) for q in got.collect()) == want and max(want.values()) == 1
    assert "NestedLoop" not in plan_of(got)


def test_campaigns(tx):
    runs = IV.campaigns(tx, per_chain=2, days=10)
    assert {(r.chain, r.campaign) for r in runs.collect()} == {(c, k) for c in CHAINS for k in (1, 2)}
    volume = IV.campaign_volume(tx, runs).collect()
    assert len(volume) == 6 and all(v.n_tx >= v.wallets > 0 for v in volume)
    found = S.sessions(tx, 1.0)
    assert {r.chain for r in IV.campaign_sessions(found, runs).collect()} == set(CHAINS)


# ------------------------------------------------------------ rolling frames

def test_rolling_volume(tx, rows):
    daily = defaultdict(lambda: [0, None])
    for r in rows:
        if r["wallet"] and r["created_at"]:
            d = daily[r["wallet"], r["created_at"].date()]
            d[0] += 1
            if r["user_send_currency_usd"] is not None:
                d[1] = round((d[1] or 0) + r["user_send_currency_usd"], 8)
    want = set()
    for (w, day), (n, usd) in daily.items():
        out = [w, day, n, usd]
        for span in (7, 30):
            frame = [v for (w2, d2), v in daily.items() if w2 == w and 0 <= (day - d2).days < span]
            sums = [v[1] for v in frame if v[1] is not None]
            out += [sum(v[0] for v in frame), round(sum(sums), 8) if sums else None, len(frame)]
        want.add(tuple(out))
    got = RO.rolling_volume(tx)
    assert {tuple(r) for r in got.collect()} == want
    peaks = {r.wallet: r for r in RO.rolling_peaks(got).collect()}
    for w, p in peaks.items():
        best = max(x[8] for x in want if x[0] == w and x[8] is not None)
        assert p.peak_usd == best and p.peak_day == min(x[1] for x in want if x[0] == w and x[8] == best)


def test_no_window_over_raw_rows(spark, tx):
    plan = plan_of(RO.rolling_volume(tx))
    window, aggregate = plan.index("Window"), plan.rindex("HashAggregate")
    assert window < aggregate  # the plan prints parents first: windows read aggregated days


# ------------------------------------------------------------ ranks

@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_exact_ranks(spark, partitions):
    r = random.Random(3)
    values = [5.0 if i % 3 == 0 else round(r.uniform(0, 10), 1) for i in range(500)] + [None] * 3
    df = spark.createDataFrame([(f"w{i:04}", v) for i, v in enumerate(values)], "wallet string, v double")
    got = RK.exact_ranks(df, "v", "wallet", 10, partitions)
    con = duckdb.connect()
    con.execute("CREATE TABLE t(wallet VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(f"w{i:04}", v) for i, v in enumerate(values)])
    want = con.execute("SELECT wallet, v, RANK() OVER (ORDER BY v), NTILE(10) OVER (ORDER BY v, wallet), PERCENT_RANK() OVER (ORDER BY v) "
                       "FROM t WHERE v IS NOT NULL").fetchall()
    assert sorted((x.wallet, x.v, x.rank, x.tile, x.pct_rank) for x in got.collect()) == sorted(want)
    assert "SinglePartition" not in plan_of(got)


def test_ranks_of_few_and_no_rows(spark):
    one = spark.createDataFrame([("a", 1.0)], "wallet string, v double")
    assert [tuple(x) for x in RK.exact_ranks(one, "v", "wallet").collect()] == [("a", 1.0, 1, 1, 0.0)]
    same = spark.createDataFrame([(f"w{i}", 1.0) for i in range(40)], "wallet string, v double")
    got = RK.exact_ranks(same, "v", "wallet", 4, 7).collect()
    assert {x.rank for x in got} == {1} and Counter(x.tile for x in got) == {1: 10, 2: 10, 3: 10, 4: 10}
    assert RK.exact_ranks(one.limit(0), "v", "wallet").count() == 0


# ------------------------------------------------------------ sketches

@pytest.mark.parametrize("sf", [SF001, SF01])
def test_sketch_error_is_within_two_percent(spark, sf):
    got = E.queries()["reach_rollup"](spark, sf)
    assert got.count() > 500 and got.where("not within_bound").count() == 0


def test_rollup_reads_no_raw_rows_and_merges_later_months(spark, tx):
    early, late = tx.where("created_at < '2025-02-01'"), tx.where("created_at >= '2025-02-01'")
    merged = SK.wallet_sketches(early).unionByName(SK.wallet_sketches(late))
    whole = SK.wallet_sketches(tx.where("created_at is not null"))
    keys = ["origin_chain_name", "month", "level"]
    a, b = ({tuple(r[k] for k in keys): (r.n_tx, r.wallets_estimate) for r in SK.reach(x, "origin_chain_name", "month").collect()}
            for x in (merged, whole))
    assert a == b
    i = catalog.Inputs(spark, SF001)
    files = SK.reach(catalog.sketches(i), "origin_chain_name", "month").inputFiles()
    assert files and all("wallet_sketches" in f for f in files)


# ------------------------------------------------------------ bag difference

def test_bag_difference(spark):
    ddl = "a string, b int, c double"
    left = [("x", 1, 0.5)] * 3 + [(None, None, None)] * 2 + [("y", None, 1.0), (None, 1, 2.0), ("same", 9, 9.0)]
    right = [("x", 1, 0.5)] + [(None, None, None)] * 4 + [("y", 1, None), ("same", 9, 9.0)]
    got = D.bag_difference(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl).select("c", "a", "b"), buckets=7)
    l, r = Counter(left), Counter(right)
    want = [(*k, "left", n) for k, n in (l - r).items()] + [(*k, "right", n) for k, n in (r - l).items()]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_equal_loads_have_no_differing_bucket(spark, tx):
    again = tx.repartition(3)
    assert D.differing_buckets(tx, again).count() == 0 and D.bag_difference(tx, again).count() == 0
    one_more = tx.unionByName(tx.limit(1))
    off = D.differing_buckets(one_more, tx)
    assert off.count() == 1
    assert [(r.side, r.copies) for r in D.bag_difference(one_more, tx).collect()] == [("left", 1)]


# ------------------------------------------------------------ incremental features

def test_append_equals_rebuild(spark, tx, tmp_dir):
    excl = [("w3", "test")]
    want = {tuple(r) for r in W.wallet_features(tx, excl, "A").collect()}
    cols = W.wallet_features(tx, excl, "A").columns
    cut = F.coalesce(F.col("created_at") < F.lit("2025-02-10"), F.lit(True))
    INC.append(tx.where(cut), excl, tmp_dir, "first")
    assert {tuple(r) for r in INC.features(spark, tmp_dir).select(*cols).collect()} != want
    for _ in range(2):  # a load that runs twice counts once
        INC.append(tx.where(~cut), excl, tmp_dir, "second")
        assert {tuple(r) for r in INC.features(spark, tmp_dir).select(*cols).collect()} == want
    INC.compact(spark, tmp_dir, f"{tmp_dir}/compacted")
    assert {tuple(r) for r in INC.features(spark, f"{tmp_dir}/compacted").select(*cols).collect()} == want


def test_append_reads_new_months_only(spark, tx, tmp_dir):
    from chainlens.sources import tables as TB
    TB.write_transactions(tx, f"{tmp_dir}/tx")
    new = W.in_window(spark.read.parquet(f"{tmp_dir}/tx"), "2025-03-01")
    plan = plan_of(INC.sums(new))
    assert "PartitionFilters: [isnotnull(month" in plan and "(month" in plan
    INC.append(new, [], f"{tmp_dir}/state", "march")
    assert all("/state/" in f for f in INC.features(spark, f"{tmp_dir}/state").inputFiles())


# ------------------------------------------------------------ semi-structured columns

def test_typed_props(spark):
    texts = ['{"k": 5, "tags": [1, "x", 3], "in": {"b": 2.5}}', '{"k": "7"}', '{"k": "seven"}', '{"k": 99999999999}', '{"k": null}', "{}", "{bad", None, "[]", '{"k": 1.5}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, props string")
    done = PR.typed(rows, "props", {"k": ("$.k", "int"), "b": ("$.in.b", "double")}, ["id"])
    got = {r.id: (r.k, r.k_text, r.k_status) for r in done.collect()}
    assert got[0] == (5, None, "ok") and got[1] == (7, None, "ok") and got[2] == (None, "seven", "mismatch")
    assert got[3] == (None, "99999999999", "mismatch")
    assert [got[i][2] for i in (4, 5, 6, 7, 8)] == ["missing", "missing", "bad json", "no json", "missing"]
    assert done.where("b_status = 'ok'").first().b == 2.5
    counts = {r.status: r.n for r in PR.status_counts(done, "k").collect()}
    assert counts["mismatch"] == 2 and sum(counts.values()) == len(texts)
    tags = PR.elements(rows, "props", "$.tags", "int", ["id"]).collect()
    assert [(r.id, r.place, r.element) for r in sorted(tags)] == [(0, 0, 1), (0, 1, None), (0, 2, 3)]


# ------------------------------------------------------------ plans

@pytest.mark.parametrize("name", ["wallet_profile", "wallet_features", "rule_segments"])
def test_no_sets_of_tokens(spark, name):
    assert "collect_set" not in plan_of(catalog.queries()[name](spark, SF001))
