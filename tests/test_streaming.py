"""Incremental ingestion: new files only, exactly once, nothing dropped."""
import os

from chainlens.config import TRANSACTION_COLUMNS
from chainlens.streaming import incremental as INC

from test_ingest import row, write_csv


def test_incremental_ingest(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    write_csv(f"{src}/a.csv", TRANSACTION_COLUMNS, [row(i) for i in range(3)])
    long_line = ",".join(row(9).values()) + ",surplus"
    write_csv(f"{src}/b.csv", TRANSACTION_COLUMNS, [row(i, wallet="w2") for i in range(3, 5)],
              raw_lines=[long_line])
    args = (spark, src, f"{tmp_dir}/table", f"{tmp_dir}/quarantine", f"{tmp_dir}/ckpt")
    INC.run_once(*args)
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 5
    assert spark.read.parquet(f"{tmp_dir}/quarantine").count() == 1
    INC.run_once(*args)  # nothing new: nothing appended
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 5
    write_csv(f"{src}/c.csv", TRANSACTION_COLUMNS, [row(i, wallet="w3") for i in range(5, 9)])
    INC.run_once(*args)
    t = spark.read.parquet(f"{tmp_dir}/table")
    assert t.count() == 9 and t.where("wallet = 'w3'").count() == 4
    assert "month" in t.columns


def test_file_with_another_column_order_is_refused(spark, tmp_dir):
    import pytest
    from pyspark.errors import StreamingQueryException

    os.makedirs(f"{tmp_dir}/in")
    write_csv(f"{tmp_dir}/in/a.csv", list(reversed(TRANSACTION_COLUMNS)), [row(1)])
    with pytest.raises(StreamingQueryException):
        INC.run_once(spark, f"{tmp_dir}/in", f"{tmp_dir}/t", f"{tmp_dir}/q", f"{tmp_dir}/c")
