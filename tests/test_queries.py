"""Every registered query against its SQL, and invariants of the whole-table results."""

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.plans import mapping as M
from tallyspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, note


def test_labelling_keeps_every_row(spark):
    n = M.table(spark, SF, "events").count()
    assert QUERIES["labelled_metrics"](spark, SF).count() == n


def test_split_conserves_unless_dropped(spark):
    total = lambda q: QUERIES[q](spark, SF).agg(F.sum("value")).first()[0]
    # a list of commas only has no members, so those rows vanish whatever the policy
    assert total("split_pass") == pytest.approx(total("split_fallback"))
    assert total("split_drop") < total("split_pass")


def test_bills_are_spent(spark):
    bills = QUERIES["bill_lines"](spark, SF).groupBy("bill_id", "metric").agg(F.sum("cents").alias("c"))
    spent = QUERIES["bill_allocation"](spark, SF).groupBy("bill_id", "metric").agg(F.sum("price").alias("p"))
    gaps = spent.join(bills, ["bill_id", "metric"]).filter(F.abs(F.col("p") - F.col("c")) > 1)
    assert spent.count() > 0 and gaps.count() == 0


def test_scans_read_only_what_they_need(spark):
    """Of lineitem's eleven columns the raw metrics use four; the labels need even fewer.

    (The events' tags are one map that also holds a value of ``props``, so that column is
    read whenever the owner tag is.)
    """
    plan = QUERIES["history_two_keys"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("ReadSchema")[1] for x in plan.splitlines() if "FileScan parquet" in x]
    lines = [s for s in scans if "l_suppkey" in s]
    used = ("l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    assert lines and all(s.count("l_") <= len(used) for s in lines)
    assert not any(c in s for s in lines for c in ("l_tax", "l_extendedprice", "l_orderkey"))
