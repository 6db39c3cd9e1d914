"""Hot customers, sweeps, key filters and buckets: same rows, and plans that keep their promise."""

import random
import re
from collections import Counter
from datetime import timedelta
from decimal import Decimal

import pytest
from brute import spark_rows
from conftest import payment, when
from pyspark.sql import functions as F

from limitline.config import SkewPolicy
from limitline.operators import entitlements, outcomes, volumes
from limitline.operators.keyfilter import key_filter, possibly_in
from limitline.operators.prefix import PIECE, running_totals
from limitline.plans.comparison import RuleComparison
from limitline.registry import BUSY, queries
from limitline.sources.schemas import SCHEMAS
from limitline.sources.star_schema import from_star_schema


def executed(df):
    """The plan that ran, with what adaptive execution made of it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ---- prefix sums


def test_running_totals_equal_the_sums(frame):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(40), rng.randrange(3), rng.randrange(-5, 9)) for _ in range(400)]
    df = frame("k bigint, at bigint, side int, x bigint", rows)
    got = running_totals(df, ["k"], ["at", "side"], "x", "bigint")
    want = Counter()
    for k, at, side, x in rows:
        total = sum(r[3] for r in rows if r[0] == k and (r[1], r[2]) <= (at, side))
        want[k, at, side, x, total] += 1
    assert Counter(tuple(r) for r in got.collect()) == want


def test_pieces_are_cut_at_quantiles_not_at_keys_or_hours(spark, monkeypatch):
    """One customer, nearly all payments within a second: every piece gets its share."""
    from limitline.operators import prefix

    seen = []
    original = prefix.materialise
    monkeypatch.setattr(prefix, "materialise", lambda df: seen.append(original(df)) or seen[-1])
    rows = spark.range(0, 20_000, 1, 8).selectExpr("7L as k", "if(id < 100, id * 1000000000, 90000000000 + id) as at", "1L as x")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_totals(rows, ["k"], ["at"], "x", "bigint")
        assert got.agg(F.max("total"), F.sum("total")).first() == (20_000, 20_000 * 20_001 // 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r["count"] for r in seen[0].groupBy(PIECE).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.5 * min(sizes)


def test_cold_customers_are_not_exchanged_again(payments, no_broadcast):
    """Beside a hot customer, the others still share the one exchange of the plain way."""
    start = when("2020-01-01")
    rows = [payment(u, start + timedelta(hours=i), 1, "LOW", i) for u in (1, 2, 3) for i in range(20)]
    df = payments(rows)
    text = volumes.linked_window_volumes(df, hot=[2], distinct=False)._jdf.queryExecution().executedPlan().toString()
    cold = text[: text.index("Scan ExistingRDD", text.index("LeftAnti"))]
    assert len(re.findall(r"Exchange hashpartitioning\(user_profile_id#\d+L, \d+\)", cold)) <= 1


def test_volume_check_balances(payments):
    start = when("2020-01-01")
    rows = [payment(i % 3, start + timedelta(hours=i % 50), i % 4 or None, "LOW", i) for i in range(200)]
    for hot in ([], [1], [0, 1, 2]):
        got = volumes.volume_check(payments(rows), hot=hot).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == {
            u: (Decimal(sum(i for i in range(200) if i % 3 == u)),) * 2 for u in range(3)
        }


# ---- verifications


def brute_verified(triggers, history):
    day = timedelta(days=1)
    out = Counter()
    for user, at in triggers:
        found = [m for u, m, v in history if u == user and v and at - day < v <= at + 7 * day]
        out.update((user, at, m) for m in found or [None])
    return out


@pytest.mark.parametrize("hot", [[], [1], [1, 2, 3]])
def test_sweep_equals_the_pairs(frame, hot):
    rng, start = random.Random(8), when("2020-01-01")
    times = [start + timedelta(days=d, microseconds=m) for d in range(20) for m in (-1, 0, 1)]
    triggers = [(rng.choice([1, 2, 3, 4]), rng.choice(times)) for _ in range(120)]
    history = [(rng.choice([1, 2, 3, 5, None]), rng.choice(["A", "B", None]), rng.choice([*times, None])) for _ in range(150)]
    got = entitlements.verified_near(
        frame("user_profile_id bigint, date_created timestamp_ntz", triggers),
        frame(SCHEMAS["profile_verification_history_sm"], history), 1, 7, hot=hot,
    )
    assert spark_rows(got) == brute_verified(triggers, history)


@pytest.mark.parametrize("hot", [[], [1]])
def test_a_busy_customer_makes_no_pairs_beyond_the_result(spark, hot, no_broadcast):
    """20,000 triggers and 20,000 verifications of one customer in ten days, none in reach but 5."""
    second = "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, {})"
    triggers = spark.range(20_000).selectExpr("1L as user_profile_id", f"{second.format('id')} as date_created")
    late = "if(id < 5, 600000, 800000 + id * 10)"
    history = spark.range(20_000).selectExpr(
        "1L as user_profile_id", "'A' as verification_method", f"{second.format(late)} as first_verification_time"
    )
    df = entitlements.verified_near(triggers, history, 1, 7, hot=hot)
    assert df.count() == 20_000 * 5
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    # Verifications and triggers meet by number alone; other joins are with pieces or hot customers.
    joins = [line for line in text.splitlines() if "Join" in line]
    assert any(re.search(r"Join \[[^\]]*number#", j) for j in joins)
    assert not any(name in j for j in joins for name in ("at_us", "date_created", "first_verification_time", "Cartesian"))


# ---- released customers


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(0, 3000).selectExpr("if(id % 100 = 0, null, id * 7) as k")
    rows = spark.range(100_000).selectExpr("id as k")
    found = key_filter(keys, "k")
    got = {r.k for r in possibly_in(rows, "k", found).collect()}
    true = {r.k for r in keys.collect() if r.k is not None}
    assert true <= got | {k for k in true if k >= 100_000} and len(got - true) < 0.01 * 100_000
    assert key_filter(keys, "k", words=4).count() <= 4
    assert possibly_in(rows, "k", key_filter(keys.limit(0), "k")).count() == 0


def test_released_requests_are_exchanged_once_and_few_scores(spark, frame, no_broadcast):
    users = frame("user_profile_id bigint, risk_level string", [(u, "LOW") for u in range(3)])
    transfers = spark.range(6000).selectExpr(
        "id % 300 as user_profile_id", "id as request_id", "timestamp_ntz'2019-05-01' as action_creation_time",
        "cast(10 as decimal(18,6)) as invoice_value_gbp", "'TRANSFERRED' as action_state",
        "'card' as payment_method", "true as engine_suspend_flag",
    )
    scores = spark.range(20_000).selectExpr("id as request_id", "id % 4 = 0 as needs_review")
    fraud = spark.range(100).selectExpr("id * 3 as request_id")
    for df, by_request in (
        (outcomes.suspension_rate(users, transfers, scores, hot=[]), 2),
        (outcomes.fraud_rate(users, transfers, fraud, scores, hot=[]), 3),
    ):
        text = executed(df)
        made = re.findall(r"- Exchange hashpartitioning\(request_id#\d+L, \d+\)", text)
        # The released requests once; scores and frauds once each; the filter reuses the first.
        assert len(made) <= by_request, text
        assert "ReusedExchange" in text
    requests = outcomes._released_requests(users, transfers, {}, [], SkewPolicy())
    kept = possibly_in(scores, "request_id", outcomes._released_filter(requests)).count()
    assert 60 <= kept <= 60 + 0.01 * 20_000


# ---- buckets


def test_bucketed_payments_are_never_exchanged(spark, sf_dir, tmp_path):
    plan = RuleComparison(from_star_schema(spark, sf_dir))
    plan.bucket_payments("bucketed_in_a_test", str(tmp_path / "payments"), buckets=4)
    df = plan.comparison()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text or "bucketed_in_a_test" in text
    assert "Exchange" not in text
    assert spark_rows(df) == spark_rows(RuleComparison(from_star_schema(spark, sf_dir)).comparison())
    spark.sql("drop table bucketed_in_a_test")


def test_disputed_tables_give_rows(spark, sf_dir):
    made = queries()
    assert made["ambiguous_users_disputed"](spark, sf_dir).count() > 0
    assert made["rule_gap_disputed"](spark, sf_dir).count() > 0
    assert made["violations_disputed"](spark, sf_dir).where("repeated_keys > 0").count() == 3


def test_busy_policy_finds_more_keys_than_the_plan_keeps(spark, sf_dir):
    from limitline.operators.skew import hot_keys
    from limitline.sources.star_schema import tied_payments

    assert len(hot_keys(tied_payments(spark, sf_dir), "user_profile_id", policy=BUSY)["user_profile_id"]) > BUSY.max_hot_keys


# ---- payments by day


def test_days_without_rates_are_not_read(spark, sf_dir, tmp_path):
    from limitline.plans.backtest import Backtest
    from limitline.sources.schemas import SCHEMAS as tables
    from limitline.sources.tables import Sources, store_by_day

    src = from_star_schema(spark, sf_dir)
    for table in tables:
        if table == "report_action_step":
            store_by_day(getattr(src, table), str(tmp_path / f"{table}.parquet"))
        else:
            getattr(src, table).write.parquet(str(tmp_path / f"{table}.parquet"))
    by_day = Sources.from_parquet(spark, str(tmp_path))
    for plan, since in ((Backtest, "2016-01-01"), (RuleComparison, "2019-01-01")):
        df = plan(by_day).payments
        text = executed(df)
        scan = re.search(r"PartitionFilters: \[([^\n]*payment_day[^\n]*)", text).group(1)
        assert since in scan or "dynamicpruning" in scan
        assert "dynamicpruning" in text
        assert spark_rows(df) == spark_rows(plan(src).payments)


def test_counters_ride_along(spark):
    from limitline.operators.grain import observed

    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k long, v string")
    df, watch = observed(rows, "facts", ["k", "v"])
    assert df.where("v = 'a'").count() == 1
    assert watch.get == {"rows": 3, "k_missing": 1, "v_missing": 1}
