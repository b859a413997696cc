"""Trips meet where their legs are numbered; keys are counted one by one only where some may be hot."""
import re

import pytest

from core_helpers import tx_rows
from test_distincts import plan_of, some_rows

from chainlens.functions import slices
from chainlens.operators import sequences as S


def test_trips_meet_where_they_are_numbered(spark):
    """One exchange of rows, and the same trips as with every pair in slices."""
    tx = tx_rows(spark, [dict(r, created_at=r["created_at"] or "2000-02-01") for r in some_rows()]).repartition(4)
    whole, cut = S.return_trips(tx), S.return_trips(tx, 5)
    assert len(re.findall("Exchange hashpartitioning", plan_of(whole))) == 1
    assert whole.count() > 20 and sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))


def test_no_table_of_counts_without_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(slices, "materialize", lambda *a: pytest.fail("counts were stored"))
    assert slices.hot_slices(tx_rows(spark, some_rows()), ["wallet"], "created_at") is None
