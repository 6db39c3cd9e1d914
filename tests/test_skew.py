from collections import Counter

import pytest
from pyspark.sql import functions as F
from brute import spark_rows

from limitline.config import SkewPolicy
from limitline.operators.skew import broadcast_if_small, hot_keys, materialise, skew_join
from limitline.plans.backtest import Backtest
from limitline.plans.comparison import RuleComparison
from limitline.plans.extracts import Extracts
from limitline.registry import BACKTEST, COMPARISON, EXTRACTS
from limitline.sources.star_schema import from_star_schema

# Everybody with more than a dozen orders is hot, and nothing may be broadcast by hint.
TIGHT = SkewPolicy(hot_rows=12, salts=3, broadcast_rows=0)


def test_hot_keys(frame):
    df = frame("k bigint, j string", [(7, "a")] * 50 + [(None, None)] * 50 + [(i, str(i)) for i in range(40)])
    found = hot_keys(df, "k", "j", policy=SkewPolicy(hot_rows=30))
    assert {k: list(v) for k, v in found.items()} == {"k": [7], "j": ["a"]}
    assert not hot_keys(df, "k")["k"]


@pytest.mark.parametrize("places", [1, 7, 1 << 16])
def test_more_hot_keys_than_the_plan_keeps(spark, places):
    """Exact counts of every key of a heavy place; beyond ``max_hot_keys`` the table is stored."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, id div 60, id) as k", "string(id % 40) as j")
    policy = SkewPolicy(hot_rows=15, max_hot_keys=5, key_places=places)
    found = hot_keys(rows, "k", "j", policy=policy)
    counts = Counter(r.k for r in rows.collect())
    assert sorted(found["k"]) == sorted(k for k, n in counts.items() if n > 15)
    assert len(found["k"]) == 50 and sorted(found["j"]) == sorted(map(str, range(40)))
    assert "Scan ExistingRDD" in found["k"].table._jdf.queryExecution().executedPlan().toString()
    side = spark.range(100).selectExpr("id as k", "id * 2 as y")
    salted = skew_join(rows, "k", [(side, "left")], found["k"], policy)
    assert spark_rows(salted) == spark_rows(rows.join(side, "k", "left"))
    cold, hot = found["k"].split(rows, "k")
    assert cold.count() + hot.count() == 3000
    assert {r.k for r in hot.collect()} == set(found["k"])


def test_many_hot_keys_are_counted_once(spark):
    """One reading finds the heavy places, one counts their keys, however many are hot."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(k):
        read.add(1)
        return k

    # Not deterministic: a filter is not pushed below it, which would call it once more.
    rows = spark.range(600).select(seen.asNondeterministic()(F.expr("id % 30")).alias("k"))
    found = hot_keys(rows, "k", policy=SkewPolicy(hot_rows=10, max_hot_keys=5))["k"]
    assert sorted(found) == list(range(30))
    assert read.value <= 2 * 600


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(frame, how):
    facts = frame("k bigint, x bigint", [(i % 5 or None, i % 7) for i in range(200)])
    side = frame("k bigint, y string", [(1, "a"), (1, "b"), (2, "c"), (9, "d"), (None, "e")])
    plain = skew_join(facts, "k", [(side, how)])
    salted = skew_join(facts, "k", [(side, how)], hot=[1, 9], policy=TIGHT)
    assert salted.columns == plain.columns
    assert spark_rows(salted) == spark_rows(plain)


def test_copies_of_one_row_are_spread(spark):
    facts = spark.range(0, 4000, 1, 40).selectExpr("1L as k", "0 as x")
    side = spark.range(1, 2).withColumnRenamed("id", "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        salted = skew_join(facts, "k", [(side, "left")], hot=[1], policy=SkewPolicy(salts=64))
        per_task = [r[0] for r in salted.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == 4000
    assert len(per_task) > 1 and max(per_task) < 3000


def test_broadcast_needs_a_proof(spark):
    df = spark.range(10)
    assert broadcast_if_small(df, 10, SkewPolicy(broadcast_rows=9)) is df
    assert broadcast_if_small(df, 10, SkewPolicy(broadcast_rows=10)) is not df


def test_materialise_cuts_the_lineage(spark):
    df = materialise(spark.range(10).selectExpr("id * 2 as x"))
    assert Counter(r.x for r in df.collect()) == Counter(range(0, 20, 2))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


PLANS = [
    *((Backtest, name, build) for name, build in BACKTEST.items() if name in (
        "payments_entitlement", "rolling_volumes_grouped", "old_rule_month_pre", "released_users",
        "suspension_rate", "fraud_rate")),
    *((RuleComparison, name, build) for name, build in COMPARISON.items() if name in (
        "payments_monitoring", "linked_volumes", "user_window_volumes", "compare_rules")),
    *((Extracts, name, EXTRACTS[name]) for name in ("lifetime_verified", "payment_verified", "payment_triggered")),
]


@pytest.mark.parametrize("plan,name,build", PLANS, ids=[p[1] for p in PLANS])
def test_the_way_for_hot_keys_gives_the_same_rows(spark, sf_dir, plan, name, build):
    src = from_star_schema(spark, sf_dir)
    tight = plan(src, policy=TIGHT)
    assert tight.hot["user_profile_id"], "the policy must find hot customers"
    assert spark_rows(build(tight)) == spark_rows(build(plan(src)))
