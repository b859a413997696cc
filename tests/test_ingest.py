"""CSV ingestion: header order, missing/extra columns, bad lines, latin1,
sample per file, drift report; table sinks and re-reads."""
import os

from pyspark.sql import functions as F

from chainlens.config import TRANSACTION_COLUMNS
from chainlens.sources import csv_ingest as CI
from chainlens.sources import tables as TB

COLS = TRANSACTION_COLUMNS


def row(i, wallet="w1", ts="2025-01-02 10:00:00", usd="10.5"):
    vals = {"created_at": ts, "wallet": wallet, "execution_kind": "Bridge", "is_call": "true",
            "route_source": "api", "deposit_tx_hash": f"d{i}", "origin_chain_name": "base",
            "user_send_currency": "USDC", "user_send_currency_amount": "1",
            "user_send_currency_usd": usd, "destination_chain_name": "zora", "fill_tx_hash": f"f{i}",
            "user_receive_currency_amount": "1", "user_receive_currency_usd": "10.4",
            "user_receive_currency": "USDC"}
    return vals


def write_csv(path, cols, rows, encoding="utf-8", raw_lines=()):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(",".join(cols) + "\n")
        for r in rows:
            f.write(",".join(r[c] for c in cols) + "\n")
        for line in raw_lines:
            f.write(line + "\n")


def make_fixtures(d):
    write_csv(f"{d}/plain_1.csv", COLS, [row(i) for i in range(3)])
    write_csv(f"{d}/plain_2.csv", COLS, [row(i, wallet="w2") for i in range(3, 5)])
    rev = list(reversed(COLS))
    write_csv(f"{d}/reordered_header.csv", rev, [row(i, wallet="w3") for i in range(5, 7)])
    write_csv(f"{d}/missing_column.csv", COLS[:-1], [row(9)])
    write_csv(f"{d}/extra_column.csv", COLS + ["bonus"], [dict(row(10), bonus="x")])
    long_line = ",".join(row(20).values()) + ",surplus"
    short_line = ",".join(list(row(21).values())[:5])
    write_csv(f"{d}/bad_lines.csv", COLS, [row(22)], raw_lines=[long_line, short_line])
    r = row(30, wallet="wé")
    write_csv(f"{d}/latin1.csv", COLS, [r], encoding="latin-1")
    write_csv(f"{d}/combined_sample.csv", COLS, [row(40, wallet="sample")])


def test_read_transactions(spark, tmp_dir):
    make_fixtures(tmp_dir)
    ing = CI.read_transactions(spark, f"{tmp_dir}/*.csv", exclude_prefix="combined_sample")
    data = ing.data
    assert data.columns == COLS
    wallets = sorted(r.wallet for r in data.select("wallet").distinct().collect())
    assert wallets == ["w1", "w2", "w3", "wé"]            # sample excluded; latin1 decoded
    # reordered file realigned by name, typed
    r3 = data.where(F.col("wallet") == "w3").orderBy("deposit_tx_hash").first()
    assert r3.user_send_currency_usd == 10.5 and r3.destination_chain_name == "zora"
    # missing / extra column files skipped and reported
    assert sorted(os.path.basename(p) for p in ing.skipped) == ["extra_column.csv", "missing_column.csv"]
    # long line quarantined, short line kept with NULLs
    assert ing.quarantine.count() == 1
    short = data.where(F.col("deposit_tx_hash").isNull()).collect()
    assert len(short) == 1 and short[0].wallet == "w1" and short[0].user_send_currency is None
    assert data.count() == 3 + 2 + 2 + 2 + 1
    assert dict(data.schema.fields[3].jsonValue())["type"] == "boolean"


def test_boolean_spellings(spark, tmp_dir):
    rows = [dict(row(i), is_call=v) for i, v in enumerate(["1", "0", "TRUE", "no", "maybe"])]
    write_csv(f"{tmp_dir}/bools.csv", COLS, rows)
    data = CI.read_transactions(spark, f"{tmp_dir}/bools.csv").data
    got = [r.is_call for r in data.orderBy("deposit_tx_hash").collect()]
    assert got == [True, False, True, False, None]


def test_schema_drift_report(spark, tmp_dir):
    make_fixtures(tmp_dir)
    h = CI.file_headers(spark, f"{tmp_dir}/*.csv")
    d = {r.file_name: r for r in CI.schema_drift(h, COLS).collect()}
    assert d["missing_column.csv"].missing == ["user_receive_currency"]
    assert d["extra_column.csv"].extra == ["bonus"]
    assert d["reordered_header.csv"].matches and not d["reordered_header.csv"].same_order
    assert not d["latin1.csv"].utf8 and d["plain_1.csv"].utf8
    assert not d["plain_1.csv"].consistent


def test_sample_per_file(spark, tmp_dir):
    make_fixtures(tmp_dir)
    s = CI.sample_per_file(spark, f"{tmp_dir}/plain_*.csv", n=2)
    counts = {r.source_file: r["count"] for r in s.groupBy("source_file").count().collect()}
    assert counts == {"plain_1.csv": 2, "plain_2.csv": 2}
    s2 = CI.sample_per_file(spark, [f"{tmp_dir}/plain_1.csv", f"{tmp_dir}/extra_column.csv"], n=5)
    assert "bonus" in s2.columns and s2.count() == 4


def test_table_sinks(spark, tmp_dir):
    make_fixtures(tmp_dir)
    data = CI.read_transactions(spark, f"{tmp_dir}/plain_*.csv").data
    TB.write_transactions(data, f"{tmp_dir}/tx")
    back = spark.read.parquet(f"{tmp_dir}/tx")
    assert back.count() == 5 and "month" in back.columns
    TB.write_table(data.limit(1), f"{tmp_dir}/tx_app", mode="overwrite")
    TB.write_table(data.limit(1), f"{tmp_dir}/tx_app", mode="append")
    assert spark.read.parquet(f"{tmp_dir}/tx_app").count() == 2
    TB.export_csv(data.groupBy("wallet").count(), f"{tmp_dir}/out_csv")
    back = TB.read_csv_result(spark, f"{tmp_dir}/out_csv", "wallet string, count long")
    assert sorted((r.wallet, r["count"]) for r in back.collect()) == [("w1", 3), ("w2", 2)]
    TB.write_bucketed(data, "tx_bucketed", f"{tmp_dir}/tx_b", buckets=4)
    assert spark.table("tx_bucketed").count() == 5


def test_bad_times_counted_and_kept(spark, tmp_dir):
    rows = [row(1), row(2, ts="not a time"), row(3, ts=""), row(4, ts="2025-02-03T04:05:06Z")]
    write_csv(f"{tmp_dir}/times.csv", COLS, rows)
    ing = CI.read_transactions(spark, f"{tmp_dir}/times.csv")
    assert ing.data.count() == 4
    assert ing.data.where(F.col("created_at").isNull()).count() == 2
    assert [r.text for r in ing.bad_times.collect()] == ["not a time"]


def test_month_partitions_prune(spark, tmp_dir):
    rows = [row(i, ts=f"2025-0{1 + i % 3}-05 10:00:00") for i in range(6)]
    write_csv(f"{tmp_dir}/months.csv", COLS, rows)
    data = CI.read_transactions(spark, f"{tmp_dir}/months.csv").data
    TB.write_transactions(data, f"{tmp_dir}/tx_m")
    q = spark.read.parquet(f"{tmp_dir}/tx_m").where(F.col("month") >= "2025-02")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert q.count() == 4


def quoted(cols, rows):
    import csv
    import io
    f = io.StringIO()
    w = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
    w.writerow(cols)
    w.writerows([r[c] for c in cols] for r in rows)
    return f.getvalue()


def test_quoted_text(spark, tmp_dir):
    odd = ['say "hi", you', "two\nlines", 'a "" b', ",", "plain"]
    with open(f"{tmp_dir}/quoted.csv", "w") as f:
        f.write(quoted(COLS, [row(i, wallet=w) for i, w in enumerate(odd)]))
    ing = CI.read_transactions(spark, f"{tmp_dir}/quoted.csv")
    assert [r.wallet for r in ing.data.orderBy("deposit_tx_hash").collect()] == odd
    assert ing.quarantine.count() == 0 and not ing.skipped and ing.data.filter("user_send_currency_usd = 10.5").count() == len(odd)


def test_quarantine_keeps_the_source_line(spark, tmp_dir):
    base = ",".join(row(1, usd="10.50").values())
    lines = [base + ",,x2", base + ",", base + ',"q,r",z', ",,10.50" + base]
    write_csv(f"{tmp_dir}/long.csv", COLS, [row(2)], raw_lines=[*lines, base])
    ing = CI.read_transactions(spark, f"{tmp_dir}/long.csv")
    assert sorted(r.line for r in ing.quarantine.collect()) == sorted(lines)
    assert ing.data.count() == 2


def test_sample_of_files_with_one_name(spark, tmp_dir):
    for d, enc in (("a", "utf-8"), ("b", "latin-1")):
        os.makedirs(f"{tmp_dir}/{d}")
        write_csv(f"{tmp_dir}/{d}/same.csv", COLS, [row(i, wallet="wé") for i in range(5)], encoding=enc)
    got = CI.sample_per_file(spark, f"{tmp_dir}/*/same.csv", 2).collect()
    assert len(got) == 4 and {r.wallet for r in got} == {"wé"}


def test_competitor_file_is_read_by_name(spark, tmp_dir):
    import pytest

    from chainlens.operators.loyalty import load_competitor_usage
    with open(f"{tmp_dir}/c.csv", "w") as f:
        f.write("tx_count,amount_usd,wallet_,platform_,source_chain,destination_chain\n3,9.25,w1,across-v3,base,zora\n")
    r = load_competitor_usage(spark, f"{tmp_dir}/c.csv").first()
    assert (r.wallet_, r.amount_usd, r.tx_count, r.source_chain) == ("w1", 9.25, 3, "base")
    with open(f"{tmp_dir}/d.csv", "w") as f:
        f.write("wallet,amount_usd\nw1,1\n")
    with pytest.raises(ValueError):
        load_competitor_usage(spark, f"{tmp_dir}/d.csv")


def test_exported_text_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("a\nb", 'say "x", y', 1), ("c", None, 2)], "k string, t string, n int")
    TB.export_csv(df, f"{tmp_dir}/out")
    assert sorted(map(tuple, TB.read_csv_result(spark, f"{tmp_dir}/out", df.schema).collect())) == [("a\nb", 'say "x", y', 1), ("c", None, 2)]


def test_line_of_many_quoted_fields_is_quarantined(spark, tmp_dir):
    base = ",".join(row(1).values())
    long_line = base + "," + ",".join(['"a,b"'] * 10_000)
    write_csv(f"{tmp_dir}/long.csv", COLS, [row(2), row(3)], raw_lines=[long_line, ",".join(row(4).values())])
    ing = CI.read_transactions(spark, f"{tmp_dir}/long.csv")
    assert [r.line for r in ing.quarantine.collect()] == [long_line] and ing.data.count() == 3
    assert CI.sample_per_file(spark, f"{tmp_dir}/long.csv", 5).count() == 3


def test_stray_quote_costs_one_line(spark, tmp_dir):
    """A quote that opens and is never closed before 10,000 rows: they all stay."""
    stray = '"' + ",".join(row(1).values())
    write_csv(f"{tmp_dir}/stray.csv", COLS, [row(0)], raw_lines=[stray, *(",".join(row(i).values()) for i in range(2, 10_002))])
    ing = CI.read_transactions(spark, f"{tmp_dir}/stray.csv")
    assert ing.data.count() == 10_001 and [r.line for r in ing.quarantine.collect()] == [stray]


def test_stray_quotes_that_pair_up_swallow_no_more_than_the_rows_between(spark, tmp_dir):
    inside = [",".join(row(i).values()) for i in range(2, 12_002)]
    write_csv(f"{tmp_dir}/pair.csv", COLS, [row(0)], raw_lines=['"' + ",".join(row(1).values()), *inside, '"' + ",".join(row(12_002).values()),
                                                               ",".join(row(12_003).values())])
    ing = CI.read_transactions(spark, f"{tmp_dir}/pair.csv")
    kept, gone = ing.data.count(), ing.quarantine.collect()
    assert kept + len(gone) == 3 and ing.data.where("deposit_tx_hash = 'd12003'").count() == 1


def test_fields_are_counted_outside_quotes(spark):
    lines = ["", "a", "a,b", ',', '"a,b",c', '"a ""q"", b",,"",x', '"open,a,b', 'a"b,c"d,e']
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", CI.n_fields(F.col("line")).alias("n"), CI.fields_of("line").alias("f")).collect()
    want = {"": 1, "a": 1, "a,b": 2, ",": 2, '"a,b",c': 2, '"a ""q"", b",,"",x': 4, '"open,a,b': 1, 'a"b,c"d,e': 2}
    assert {r.line: r.n for r in got} == want and all(len(r.f) == r.n for r in got)
    assert next(r.f for r in got if r.line.startswith('"a ""')) == ['a "q", b', "", "", "x"]


def test_each_file_is_parsed_once(spark, tmp_dir):
    """Data, quarantine and unparsed times are read from the stored rows, the drift report from the stored headers."""
    write_csv(f"{tmp_dir}/a.csv", COLS, [row(1), row(2, ts="never")])
    ing = CI.read_transactions(spark, f"{tmp_dir}/a.csv")
    for df in (ing.data, ing.quarantine, ing.bad_times, ing.drift):
        files = df.inputFiles()
        assert files and all("/csv-" in f and f.endswith(".parquet") for f in files)
