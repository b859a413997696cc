"""End-to-end batch run on real inputs.

    python -m chainlens.plans.run --transactions 'in/*.csv' \\
        --competitor extract.csv --out /shared/analysis [--sample-prefix combined_sample]

Reads the transaction CSVs (header realignment, quarantine, Latin-1),
writes the transaction table month-partitioned, reads the competitor
extract, then runs every job of the catalog on those inputs with the
published parameters and the fitted model, writing each result under
``out/<name>``: Parquet for wallet-grain tables, one header CSV file for
group-grain reports.  The checkpoint folder must be shared storage
(``spark.checkpoint.dir``).
"""

from __future__ import annotations

import argparse
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from chainlens.config import REFERENCE_EXCLUSIONS, Params
from chainlens.operators import loyalty as L
from chainlens.plans import catalog
from chainlens.sources import csv_ingest as CI
from chainlens.sources import tables as TB

#: Outputs at wallet (or finer) grain: written as Parquet in parallel parts.
WALLET_GRAIN = {
    "wallet_profile", "recent_transactions", "rule_segments", "wallet_features",
    "wallet_features_window", "first_usage", "competitor_usage", "home_route_usage",
    "competitor_overlap", "loyalty_aggregate", "loyalty_class", "features_log1p",
    "features_log10", "features_scaled", "volume_segments", "assign_fixed_centroids",
    "loyalty_persona", "pca_scores", "kmeans_assign", "kmeans_assign_a", "route_share", "return_routes",
    "bridge_after_swap", "return_trips", "wallet_sessions", "session_summary", "rolling_volume", "rolling_peaks",
    "wallet_volume_ranks", "wallet_activity_ranks", "wallet_features_incremental",
}
#: Entries on the driver's tables (a fixed wallet, raw competitor events, event properties) that have no meaning on these inputs.
SKIP = {"route_lookup", "home_before_competitor", "route_bag_difference", "event_props", "event_prop_report", "unserved_routes_aliased"}


def run_analysis(spark: SparkSession, transactions: str | list[str], competitor: str, out: str,
                 p: Params | None = None, exclusions=None, sample_prefix: str | None = None,
                 names: Iterable[str] | None = None) -> dict[str, str]:
    p = p or Params.reference()
    out = out.rstrip("/")
    ing = CI.read_transactions(spark, transactions, exclude_prefix=sample_prefix)
    TB.write_transactions(ing.data, f"{out}/transactions")
    ing.quarantine.write.mode("overwrite").parquet(f"{out}/quarantine")
    ing.bad_times.write.mode("overwrite").parquet(f"{out}/unparsed_times")
    TB.export_csv(ing.drift.drop("columns", "missing", "extra"), f"{out}/schema_drift")
    tx = spark.read.parquet(f"{out}/transactions")
    usage = L.load_competitor_usage(spark, competitor)
    inputs = catalog.Inputs(spark, None, p, tx=tx, competitor_usage=usage,
                            exclusions=exclusions if exclusions is not None else REFERENCE_EXCLUSIONS)
    written: dict[str, str] = {}
    builders = catalog.builders(p)
    for name in (names or builders):
        if name in SKIP:
            continue
        df: DataFrame = builders[name](inputs)
        path = f"{out}/{name}"
        if name in WALLET_GRAIN:
            df.write.mode("overwrite").parquet(path)
        else:
            TB.export_csv(df, path)
        written[name] = path
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--transactions", required=True, nargs="+")
    ap.add_argument("--competitor", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--sample-prefix", default=None)
    args = ap.parse_args(argv)
    from chainlens.session import get_session
    spark = get_session()
    run_analysis(spark, args.transactions, args.competitor, args.out, sample_prefix=args.sample_prefix)


if __name__ == "__main__":
    main()
