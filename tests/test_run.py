"""End-to-end run on CSV inputs with the fitted model."""
import os
import random

from chainlens.config import TRANSACTION_COLUMNS, Params
from chainlens.plans import catalog
from chainlens.plans.run import SKIP, run_analysis

from test_ingest import write_csv


def make_inputs(d):
    rnd = random.Random(3)
    chains = ["base", "bsc", "solana", "arbitrum", "optimism", "zora"]
    rows = []
    for i in range(600):
        w = f"0xw{rnd.randint(0, 59)}"
        heavy = w in ("0xw1", "0xw2")
        rows.append({
            "created_at": f"2025-0{rnd.randint(1, 6)}-{rnd.randint(1, 28):02d} 10:{rnd.randint(0, 59):02d}:00",
            "wallet": w, "execution_kind": rnd.choice(["Bridge", "Cross chain swap", "Other"]),
            "is_call": rnd.choice(["1", "0"]), "route_source": rnd.choice(["api", "app", ""]),
            "deposit_tx_hash": f"d{i}", "origin_chain_name": rnd.choice(chains[:6 if heavy else 2]),
            "user_send_currency": rnd.choice(["USDC", "ETH", "SOL"]),
            "user_send_currency_amount": "1", "user_send_currency_usd": f"{rnd.uniform(1, 500):.2f}",
            "destination_chain_name": rnd.choice(chains), "fill_tx_hash": f"f{i}",
            "user_receive_currency_amount": "1", "user_receive_currency_usd": f"{rnd.uniform(1, 500):.2f}",
            "user_receive_currency": "USDC"})
    write_csv(f"{d}/tx_1.csv", TRANSACTION_COLUMNS, rows[:300])
    write_csv(f"{d}/tx_2.csv", list(reversed(TRANSACTION_COLUMNS)), rows[300:])
    comp_cols = ["wallet_", "source_chain", "platform_", "destination_chain", "amount_usd", "tx_count"]
    comp = [{"wallet_": f"0xw{j}", "source_chain": "base", "platform_": rnd.choice(["across-v3", "deBridge"]),
             "destination_chain": rnd.choice(chains), "amount_usd": "12.5", "tx_count": "2"} for j in range(0, 80, 3)]
    write_csv(f"{d}/competitor.csv", comp_cols, comp)


def test_run_analysis_end_to_end(spark, tmp_dir):
    make_inputs(tmp_dir)
    p = Params.reference().with_(heavy_min_tx=15, top_k_wallets=10, sample_per_cluster=5, k_max=4)
    names = [n for n in catalog.builders(p) if n != "kmeans_sweep"]
    out = run_analysis(spark, [f"{tmp_dir}/tx_1.csv", f"{tmp_dir}/tx_2.csv"], f"{tmp_dir}/competitor.csv",
                       f"{tmp_dir}/out", p=p, names=names)
    assert "route_lookup" not in out and len(out) == len(set(names) - SKIP)
    final = spark.read.parquet(out["loyalty_persona"])
    assert final.count() == 60
    assert {r.loyalty_type for r in final.select("loyalty_type").distinct().collect()} == {"home-only", "multi-platform"}
    assert final.select("persona").distinct().count() >= 1
    assert os.path.exists(f"{tmp_dir}/out/transactions")
    dist = spark.read.option("header", True).csv(out["persona_distribution"])
    assert sum(int(r.wallets) for r in dist.collect()) == 60


def test_retention_comes_before_every_analysis(spark, tmp_dir):
    base = {c: "" for c in TRANSACTION_COLUMNS} | {"execution_kind": "Bridge", "origin_chain_name": "base", "destination_chain_name": "bsc"}
    rows = [base | {"wallet": w, "created_at": t, "deposit_tx_hash": str(i), "user_send_currency_usd": "1"} for i, (w, t) in enumerate([
        ("old", "2024-12-31 23:59:59"), ("w1", "2024-06-01 00:00:00"), ("w1", "2025-01-01 00:00:00"), ("w1", "2025-03-01 00:00:00"), ("none", "")])]
    write_csv(f"{tmp_dir}/tx.csv", TRANSACTION_COLUMNS, rows)
    write_csv(f"{tmp_dir}/c.csv", ["wallet_", "source_chain", "platform_", "destination_chain", "amount_usd", "tx_count"], [])
    names = ["wallet_features", "wallet_features_window", "top_wallets", "wallet_profile", "rule_segments", "recent_transactions",
             "first_usage", "home_route_usage", "retention_counts", "monthly_transactions"]
    out = run_analysis(spark, f"{tmp_dir}/tx.csv", f"{tmp_dir}/c.csv", f"{tmp_dir}/out", names=names)

    def read(name):
        df = spark.read.parquet(out[name]) if name not in ("top_wallets", "retention_counts", "monthly_transactions") \
            else spark.read.option("header", True).csv(out[name])
        return df.collect()

    assert {r.wallet: int(r.deposit_tx_count) for r in read("wallet_features")} == {"w1": 2, "none": 1}
    assert {r.wallet: int(r.n_tx) for r in read("top_wallets")} == {"w1": 2, "none": 1}
    for name in ("wallet_profile", "rule_segments", "recent_transactions"):
        assert {r.wallet for r in read(name)} == {"w1", "none"}
    for name in ("wallet_features_window", "first_usage"):
        assert {r.wallet for r in read(name)} == {"w1"}
    r = read("retention_counts")[0]
    assert (r.rows_before, r.rows_deleted, r.rows_after) == ("5", "2", "3")
    assert sum(int(r.n_tx) for r in read("monthly_transactions")) == 5
    # the window names its months, so other months' folders are not read
    tx = spark.read.parquet(f"{tmp_dir}/out/transactions")
    p = Params.reference()
    plan = catalog.builders(p)["wallet_features_window"](catalog.Inputs(spark, None, p, tx=tx, exclusions=[]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_transaction_files_are_sorted(spark, tmp_dir):
    from pyspark.sql import functions as F

    from chainlens.sources import tables as TB
    rows = [(f"2025-0{1 + i % 4}-{1 + i % 28:02d}", f"w{(i * 7) % 50}") for i in range(4000)]
    tx = spark.createDataFrame(rows, "t string, wallet string").select(F.to_timestamp("t").alias("created_at"), "wallet").repartition(6)
    TB.write_transactions(tx, f"{tmp_dir}/tx")
    import glob

    import pyarrow.parquet as pq
    files = glob.glob(f"{tmp_dir}/tx/month=*/*.parquet")
    assert len(files) < 2 * 4 + 8
    for f in files:
        own = list(zip(*(pq.ParquetFile(f).read()[c].to_pylist() for c in ("wallet", "created_at"))))
        assert own == sorted(own)


def test_changed_inputs_are_staged_anew(spark, tmp_dir):
    from chainlens.sources import tables as TB
    path = f"file://{tmp_dir}/in"
    for n in (10, 4):
        spark.range(n).write.mode("overwrite").parquet(path)
        assert TB.staged(spark, "probe", lambda: spark.read.parquet(path), [path]).count() == n
