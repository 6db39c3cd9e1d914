from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from brute import self_join, spark_rows
from conftest import payment, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limitline.config import SkewPolicy
from limitline.operators import volumes as v

FORMS = {
    "grouped": v.rolling_volumes_grouped,
    "linked": v.linked_volumes,
    "linked_window": v.linked_window_volumes,
    "user_window": v.user_window_volumes,
}


def eur(*values):
    return tuple(Decimal(x) for x in values)


def test_window_is_open_at_its_lower_end(payments):
    rows = [payment(1, "2020-01-01", 7, "LOW", 600), payment(1, "2020-03-31", 7, "LOW", 500)]
    second = v.rolling_volumes_grouped(payments(rows)).filter("refdate > '2020-02-01'")
    assert rows_of(
        second, "last_90d_volume", "last_135d_volume", "last_180d_volume", "lifetime_volume"
    ) == [eur(500, 1100, 1100, 1100)]


def test_one_microsecond_earlier_is_inside(payments):
    rows = [
        payment(1, "2020-01-01", 7, "LOW", 600),
        payment(1, "2020-03-30T23:59:59.999999", 7, "LOW", 500),
    ]
    second = v.rolling_volumes_grouped(payments(rows)).filter("refdate > '2020-02-01'")
    assert rows_of(second, "last_90d_volume") == [eur(1100)]


def test_ties_of_one_group(payments):
    rows = payments([payment(2, "2020-01-01", 7, "LOW", 300), payment(2, "2020-01-01", 7, "LOW", 200)])
    assert rows_of(v.rolling_volumes_grouped(rows), "lifetime_volume") == [eur(1000)]
    assert rows_of(v.rolling_volumes_grouped(rows, ties="once"), "lifetime_volume") == [eur(500)]
    names = ("lifetime_volume", "same_recipient_volume", "linked_last_90d_volume", "any_last_90d_volume")
    assert rows_of(v.monitoring_volumes(rows), *names) == [eur(1000, 1000, 1000, 1000)]
    assert rows_of(v.monitoring_volumes(rows, ties="once"), *names) == [eur(500, 500, 500, 500)]


def test_ties_over_two_recipients(payments):
    rows = payments([payment(3, "2020-01-01", 1, "LOW", 300), payment(3, "2020-01-01", 2, "LOW", 200)])
    assert rows_of(v.rolling_volumes_grouped(rows), "recipient_id", "lifetime_volume") == [
        (1, Decimal(500)), (2, Decimal(500)),
    ]
    assert rows_of(
        v.monitoring_volumes(rows),
        "recipient_id", "lifetime_volume", "any_last_90d_volume", "same_recipient_volume",
    ) == [(1, *eur(1000, 1000, 300)), (2, *eur(1000, 1000, 200))]


def test_unknown_recipient_is_never_the_same(payments):
    rows = payments([payment(4, "2020-01-01", None, "LOW", 1500)] * 2)
    assert rows_of(
        v.monitoring_volumes(rows), "lifetime_volume", "same_recipient_volume", "linked_last_90d_volume"
    ) == [eur(6000, 0, 0)]


def test_volume_by_risk_leaves_unknown_levels_empty(payments):
    rows = [payment(u, "2020-01-01", 1, risk, 10) for u, risk in enumerate(["LOW", "HIGH", "??", None])]
    picked = v.volume_by_risk(v.rolling_volumes_grouped(payments(rows)))
    assert rows_of(picked, "user_profile_id", "volume_at_day") == [
        (0, Decimal(10)), (1, Decimal(10)), (2, None), (3, None),
    ]


def test_rejects_an_unknown_tie_rule(payments):
    with pytest.raises(ValueError):
        v.linked_volumes(payments([payment(1, "2020-01-01", 1, "LOW", 1)]), ties="twice")


def test_zone_of_the_session_does_not_matter(spark, payments):
    rows = [
        payment(1, "2021-03-14T02:30:00", 7, "LOW", 600),
        payment(1, "2021-06-12T02:29:59.999999", 7, "LOW", 500),
        payment(1, "2021-06-12T02:30:00", 7, "LOW", 100),
        payment(1, "2021-11-07T01:30:00", 7, "LOW", 50),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark_rows(v.linked_window_volumes(payments(rows)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == self_join(rows, "linked_window")


# Few users, recipients and instants, so that ties, unknown recipients and distances of
# exactly a window length are common.
instants = st.builds(
    lambda days, micro: datetime(2020, 1, 1) + timedelta(days=days, microseconds=micro),
    st.sampled_from([0, 1, 45, 89, 90, 91, 134, 135, 136, 179, 180, 181, 270, 400]),
    st.sampled_from([-1, 0, 0, 0, 1, 3_600_000_000]),
)
some_payments = st.lists(
    st.builds(
        payment,
        user=st.integers(1, 3),
        time=instants,
        recipient=st.sampled_from([None, 1, 2]),
        risk=st.sampled_from(["LOW", "HIGH", None]),
        eur=st.sampled_from(["0", "0.00000001", "123.45678901", "499.99999999", "500", "1999.00000007"]),
        currency=st.sampled_from(["EUR", "USD"]),
        product=st.sampled_from(["SENDMONEY", "BALANCE"]),
    ),
    min_size=20,
    max_size=60,
)


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("hot", [[], [1], [1, 2, 3]], ids=["plain", "mixed", "hot"])
@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(rows=some_payments)
def test_windows_equal_the_self_join(payments, form, hot, rows):
    got = spark_rows(FORMS[form](payments(rows), hot=hot))
    assert got == self_join(rows, form)


def test_hot_customers_are_found_and_computed_alike(payments):
    start = datetime(2020, 1, 1)
    rows = [
        payment(1, start + timedelta(hours=7 * i), i % 3 or None, "LOW", i + 1) for i in range(300)
    ] + [payment(u, start + timedelta(days=u), 1, "HIGH", u) for u in range(2, 40)]
    small = SkewPolicy(hot_rows=100)
    df = payments(rows)
    for form, build in FORMS.items():
        assert spark_rows(build(df, policy=small)) == spark_rows(build(df)), form


@pytest.mark.parametrize("hot_rows", [10**6, 20], ids=["plain", "hot"])
@pytest.mark.parametrize("form", FORMS)
def test_tasks_get_a_bounded_number_of_payments(spark, payments, form, hot_rows):
    """Whatever adaptive execution merges, the payments are dealt to as many tasks as they need."""
    start = datetime(2020, 1, 1)
    rows = [payment(i % 90, start + timedelta(hours=i % 97), i % 3 or None, "LOW", i + 1) for i in range(900)]
    rows += [payment(900, start + timedelta(hours=i), 1, "HIGH", i) for i in range(60)]
    df = payments(rows)
    got = FORMS[form](df, policy=SkewPolicy(hot_rows=hot_rows, task_rows=30))
    per_task = got.groupBy(F.spark_partition_id()).count()
    assert per_task.count() > 20 and per_task.agg(F.max("count")).first()[0] < 240
    assert spark_rows(got) == spark_rows(FORMS[form](df, hot=[]))


def test_volumes_grow_with_the_window(payments, spark, sf_dir):
    from limitline.sources.star_schema import tied_payments

    wide = v.monitoring_volumes(tied_payments(spark, sf_dir))
    kinds = [f"{kind}_last_{d}d_volume" for kind in ("linked", "any") for d in (90, 135, 180)]
    wrong = (
        "linked_last_90d_volume > linked_last_135d_volume or linked_last_135d_volume > linked_last_180d_volume"
        " or linked_last_180d_volume > same_recipient_volume or any_last_90d_volume > any_last_135d_volume"
        " or any_last_135d_volume > any_last_180d_volume or any_last_180d_volume > lifetime_volume"
    )
    assert set(kinds) <= set(wide.columns)
    assert wide.filter(wrong).count() == 0


def busy_customers(customers, each, recipients=3):
    start = datetime(2020, 1, 1)
    return [
        payment(u, start + timedelta(days=5 * i, hours=u), i % recipients or None, "LOW", i + u)
        for u in range(customers) for i in range(each)
    ]


@pytest.mark.parametrize("form", FORMS)
def test_only_customers_over_several_pieces_ask_for_totals(payments, monkeypatch, form):
    """A hot customer inside one piece has its totals there: no row per window is made or moved."""
    asked, original = [], v.running_totals
    monkeypatch.setattr(v, "running_totals", lambda rows, *a, **k: asked.append(rows) or original(rows, *a, **k))
    df = payments(busy_customers(customers=40, each=60))
    got = FORMS[form](df, policy=SkewPolicy(hot_rows=50, task_rows=400))
    divided = {r[0] for rows in asked for r in rows.select(v.USER).distinct().collect()}
    # 2400 payments are cut into 6 pieces, by 5 cuts.
    assert 0 < len(divided) <= 5
    assert spark_rows(got) == spark_rows(FORMS[form](df, hot=[]))


@pytest.mark.parametrize("form", FORMS)
def test_one_instant_with_more_payments_than_a_task_holds(payments, monkeypatch, form):
    """Equal times can't be cut apart; such a customer still is not one task's windows."""
    asked, original = [], v.running_totals
    monkeypatch.setattr(v, "running_totals", lambda rows, *a, **k: asked.append(rows) or original(rows, *a, **k))
    rows = [payment(1, "2020-01-01", i % 100 or None, "LOW", i) for i in range(300)]
    rows += [payment(2, "2020-01-01", 1, "LOW", i) for i in range(30)]
    got = FORMS[form](payments(rows), policy=SkewPolicy(hot_rows=20, task_rows=50))
    assert {r[0] for part in asked for r in part.select(v.USER).distinct().collect()} >= {1}
    assert spark_rows(got) == spark_rows(FORMS[form](payments(rows), hot=[]))


@pytest.mark.parametrize("name", ["hot_rolling_volumes_grouped", "hot_linked_window_volumes"])
def test_payments_are_joined_once(spark, sf_dir, name):
    """The search, the cold and the hot way read the stored payments, not the tables again."""
    from limitline.registry import queries

    assert not [f for f in queries()[name](spark, sf_dir).inputFiles() if f.startswith(f"file://{sf_dir}/")]


@pytest.mark.parametrize("form", FORMS)
def test_volumes_of_hot_and_cold_customers_are_not_exchanged_together(spark, payments, form):
    """Groups and distinct rows are made where a customer's volumes are, below the union."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = FORMS[form](payments(busy_customers(customers=6, each=20)), hot=[2, 3])
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Union" in text and "Exchange" not in text[: text.index("Union")]


@pytest.mark.parametrize("form,asked", [("grouped", 1 + 4), ("linked", 2), ("linked_window", 4), ("user_window", 4)])
def test_only_totals_that_are_read_are_asked_for(payments, monkeypatch, form, asked):
    """One customer over all pieces: rows asked for per distinct time, or (recipient, time)."""
    rows, original = [], v.running_totals
    monkeypatch.setattr(v, "running_totals", lambda df, *a, **k: rows.append(df) or original(df, *a, **k))
    df = payments(busy_customers(customers=1, each=200, recipients=1))
    df = df.withColumn("target_recipient_id", F.lit(5).cast("long"))
    got = FORMS[form](df, policy=SkewPolicy(hot_rows=50, task_rows=40))
    assert sum(r.count() for r in rows) == asked * 200
    assert spark_rows(got) == spark_rows(FORMS[form](df, hot=[]))


@pytest.mark.parametrize("form", FORMS)
def test_hot_payments_without_a_time(payments, form):
    """They count in the lifetime of later ones and have no row, in one piece or over several."""
    rows = [*busy_customers(customers=2, each=60), *(payment(u, None, r, "LOW", 7) for u in range(2) for r in (1, None))]
    df = payments(rows)
    whole = spark_rows(FORMS[form](df, policy=SkewPolicy(hot_rows=50, task_rows=1000)))
    assert whole == spark_rows(FORMS[form](df, policy=SkewPolicy(hot_rows=50, task_rows=20)))
    plain = FORMS[form](df, hot=[])
    assert whole == spark_rows(plain.where("refdate is not null")) != spark_rows(plain)
