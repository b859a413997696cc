"""Fixtures and builders that test modules import by name; conftest modules of other folders cannot shadow them."""
import datetime as dt

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

TX_DDL = ("created_at timestamp, wallet string, execution_kind string, is_call boolean, "
          "route_source string, deposit_tx_hash string, origin_chain_name string, "
          "user_send_currency string, user_send_currency_amount double, "
          "user_send_currency_usd double, destination_chain_name string, fill_tx_hash string, "
          "user_receive_currency_amount double, user_receive_currency_usd double, "
          "user_receive_currency string")


def tx_rows(spark, rows):
    """rows: dicts with any subset of the transaction columns."""
    cols = [c.split()[0] for c in TX_DDL.split(", ")]
    out = []
    for r in rows:
        r = dict(r)
        if isinstance(r.get("created_at"), str):
            r["created_at"] = dt.datetime.fromisoformat(r["created_at"])
        out.append(tuple(r.get(c) for c in cols))
    return spark.createDataFrame(out, TX_DDL)
