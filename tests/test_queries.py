"""Every registered query against its SQL counterpart, and the shape of key plans."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from limitline import oracle, registry
from limitline.operators import volumes
from limitline.registry import BACKTEST, COMPARISON
from limitline.plans.backtest import Backtest
from limitline.plans.comparison import RuleComparison
from limitline.sources.star_schema import from_star_schema, tied_payments

# The training-data queries are tested in tests/llm.
QUERIES = registry.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in ("orders", "customer", "lineitem"):
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(columns, result.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 56


def test_months_of_the_window_rules_follow_the_lifetime_rule(spark, sf_dir):
    table = QUERIES["compare_rules"](spark, sf_dir)
    late = " or ".join(f"{r}_reached_month < pgl_reached_month" for r in ("lro", "lttw", "ltto"))
    assert table.filter("pgl_reached_month is null").count() == 0
    assert table.filter(late).count() == 0


def test_stored_payments_give_the_same_tables(spark, sf_dir, tmp_path):
    src = from_star_schema(spark, sf_dir)
    for plan, build, name in (
        (Backtest(src), BACKTEST["old_rule_month"], "old_rule_month"),
        (RuleComparison(src), COMPARISON["compare_rules"], "compare_rules"),
    ):
        plan.store_payments(str(tmp_path / name))
        got = Counter(tuple(r) for r in build(plan).collect())
        assert got == Counter(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())
        assert all(str(tmp_path) in f for f in plan.payments.inputFiles())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_windows_share_one_exchange(spark, sf_dir):
    wide = volumes.monitoring_volumes(tied_payments(spark, sf_dir), hot=[])
    text = plan_of(wide)
    assert text.count("Window [") >= 2
    assert len(re.findall(r"Exchange hashpartitioning\(o_custkey|Exchange hashpartitioning\(user_profile_id", text)) == 1
    assert "unboundedpreceding" in text and "SlidingWindow" not in text


def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)


@pytest.mark.parametrize("plan,name", [(Backtest, "released_users"), (Backtest, "fraud_rate"), (RuleComparison, "compare_rules")])
def test_nothing_pairs_or_broadcasts_without_bound(spark, sf_dir, plan, name):
    """With Spark's own broadcasts off, only what has a bound is: the counted rates, and the
    filters of released ids, which have a fixed size."""
    build = {**BACKTEST, **COMPARISON}[name]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        no_broadcast(spark)
        text = plan_of(build(plan(from_star_schema(spark, sf_dir))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    keys = re.findall(r"BroadcastHashJoin \[(\w+)", text)
    assert set(keys) <= {"source_currency", "_word"} and "source_currency" in keys
    assert ("_word" in keys) == (name == "fraud_rate")
    by_user = len(re.findall(r"Exchange hashpartitioning\(user_profile_id#\d+L, \d+\)", text))
    if name == "compare_rules":
        # payments, profiles, risk levels: the windows and all that follows add none
        assert by_user <= 3


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan_of(QUERIES["customer_total"](spark, sf_dir))
    scan = re.search(r"FileScan parquet \[(.*?)\].*PushedFilters: \[(.*?)\]", text)
    assert "o_orderstatus" not in scan.group(1)
    assert "EqualTo(o_custkey,359)" in scan.group(2)
