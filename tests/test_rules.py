"""Limit dates, months, preconditions and eligibility on hand-computed cases."""

from datetime import date

import pytest
from conftest import payment, rows_of, when

from limitline.operators import compare, limits, reports
from limitline.operators import volumes as v

MONTHS = "risk_level string, user_profile_id bigint, month_rule_hit date"
DATES = "risk_level string, user_profile_id bigint, source_currency string, dateoflimit timestamp_ntz"
JAN, FEB, MAR = date(2020, 1, 1), date(2020, 2, 1), date(2020, 3, 1)


def users(df):
    return [r[0] for r in rows_of(df, "user_profile_id")]


def monitored(payments, rows):
    wide = v.monitoring_volumes(payments(rows))
    return {
        r.user_profile_id: tuple(r[m] is not None for m in compare.REACHED)
        for r in compare.monitoring_months(wide).collect()
    }


def test_old_rule_hits_where_the_new_one_does_not(payments):
    rows = payments([payment(1, "2020-01-01", 7, "LOW", 600), payment(1, "2020-03-31", 7, "LOW", 500)])
    volumes = v.rolling_volumes_grouped(rows)
    old = limits.limit_date(volumes, "lifetime_volume")
    assert rows_of(old, "dateoflimit") == [(when("2020-03-31"),)]
    assert limits.limit_date(v.volume_by_risk(volumes), "volume_at_day").count() == 0
    assert rows_of(limits.month_hit(old)) == [("LOW", 1, MAR)]


def test_unknown_recipient_and_unknown_risk(payments):
    hit = monitored(payments, [
        payment(4, "2020-01-01", None, "LOW", 1500), payment(5, "2020-01-01", 1, None, 1500),
    ])
    # pgl, lro, lttw, ltto
    assert hit == {4: (True, False, False, True), 5: (True, True, False, False)}


def test_eligibility_by_product_currency_and_address(payments):
    hit = monitored(payments, [
        payment(6, "2020-01-01", 1, "LOW", 1500, product="CARD"),
        payment(7, "2020-01-01", 1, "LOW", 1500, currency="USD", us=True),
        payment(8, "2020-01-01", 1, "LOW", 1500, currency="USD", us=False, tw=False),
        payment(9, "2020-01-01", 1, "LOW", 1500, product="BALANCE", currency="BRL", tw=True),
        payment(10, "2020-01-01", 1, "LOW", 1500, product="BALANCE", tw=False),
        payment(11, "2020-01-01", 1, "LOW", 1500, currency="BRL"),
    ])
    assert sorted(hit) == [8, 9]


def test_single_payment_limit(payments):
    rows = payments([
        payment(1, "2020-01-15", 1, "LOW", "999.99999999"),
        payment(1, "2020-02-15", 1, "LOW", 1000),
        payment(1, "2020-03-15", 1, "LOW", 5000),
        payment(2, "2020-03-15", 1, None, 5000, currency="USD"),
    ])
    hits = limits.single_payment_hit(rows)
    assert rows_of(hits) == [("LOW", 1, FEB)]


@pytest.mark.parametrize(
    "limits_of_user,orders_of_user,kept",
    [
        ([], [], True),
        ([when("2020-04-30")], [], False),
        ([when("2020-05-01")], [], True),
        ([when("2020-04-30"), when("2020-05-01")], [], True),
        ([None], [], True),
        ([], [(when("2020-06-01"), when("2020-04-01"))], False),
        ([], [(when("2020-06-01"), when("2020-04-01")), (when("2020-04-01"), when("2020-06-01"))], False),
        ([], [(when("2020-06-01"), None)], True),
    ],
)
def test_preconditions(frame, limits_of_user, orders_of_user, kept):
    hits = frame(DATES, [("LOW", 12, "EUR", when("2020-05-01"))])
    verified = frame(
        "user_profile_id bigint, dateoflimit timestamp_ntz", [(12, d) for d in limits_of_user]
    )
    products = frame(
        "profile_id bigint, account_details_order_time timestamp_ntz, card_order_time timestamp_ntz",
        [(12, *pair) for pair in orders_of_user],
    )
    got = limits.month_hit(hits, verified=verified, products=products)
    assert users(got) == ([12] if kept else [])


def test_default_cutoff(frame):
    hits = frame(DATES, [
        ("LOW", 1, "EUR", when("2021-01-01")), ("LOW", 2, "EUR", when("2021-01-01T00:00:00.000001")),
    ])
    verified = frame("user_profile_id bigint, dateoflimit timestamp_ntz", [])
    products = frame(
        "profile_id bigint, account_details_order_time timestamp_ntz, card_order_time timestamp_ntz", []
    )
    assert users(limits.month_hit(hits, verified=verified, products=products)) == [1]


def test_months_count_only_listed_currencies(frame):
    hits = frame(DATES, [
        ("LOW", 1, "USD", when("2020-01-05")), ("LOW", 1, "EUR", when("2020-02-05")),
        ("LOW", 2, "BRL", when("2020-01-05")),
    ])
    assert rows_of(limits.month_hit(hits)) == [("LOW", 1, FEB)]


def test_released_users_follow_not_in(frame):
    old = frame(MONTHS, [("LOW", 1, JAN), ("HIGH", 1, FEB), ("LOW", 2, JAN), ("LOW", None, JAN)])
    new = frame(MONTHS, [("LOW", 2, JAN)])
    assert rows_of(compare.released_users(old, new)) == [(1, "HIGH"), (1, "LOW")]
    with_null = frame(MONTHS, [("LOW", 2, JAN), ("LOW", None, JAN)])
    assert compare.released_users(old, with_null).count() == 0
    nobody = frame(MONTHS, [])
    assert compare.released_users(old, nobody).count() == 4


def test_released_users_in_one_pass(frame):
    months = frame(
        "risk_level string, user_profile_id bigint, old_month date, new_month date",
        [("LOW", 1, JAN, None), ("HIGH", 1, FEB, None), ("LOW", 2, JAN, FEB), ("LOW", 3, JAN, None),
         ("HIGH", 3, None, MAR), ("LOW", 4, None, JAN)],
    )
    old = months.selectExpr("risk_level", "user_profile_id", "old_month as month_rule_hit").dropna(
        subset=["month_rule_hit"]
    )
    new = months.selectExpr("risk_level", "user_profile_id", "new_month as month_rule_hit").dropna(
        subset=["month_rule_hit"]
    )
    expected = [(1, "HIGH"), (1, "LOW")]
    assert rows_of(compare.released_from_months(months)) == expected
    assert rows_of(compare.released_users(old, new)) == expected


def test_comparison_joins_on_the_customer_alone(frame):
    wide = frame(
        "risk_level string, user_profile_id bigint, pgl_reached_month date, lro_reached_month date, "
        "lttw_reached_month date, ltto_reached_month date",
        [
            ("LOW", 1, JAN, None, None, FEB), ("HIGH", 1, FEB, MAR, None, MAR), (None, 2, JAN, None, None, None),
            ("LOW", 3, None, None, None, JAN), ("LOW", 4, None, JAN, None, None), ("HIGH", 4, None, None, None, MAR),
        ],
    )

    def rule(name):
        month = f"{name}_reached_month"
        return wide.selectExpr("risk_level", "user_profile_id", f"{month} as month_rule_hit").dropna(
            subset=["month_rule_hit"]
        )

    joined = compare.compare_rules(*(rule(r) for r in compare.RULES))
    assert rows_of(compare.compare_months(wide)) == rows_of(joined)
    assert joined.filter("user_profile_id = 1").count() == 8
    assert users(joined.filter("user_profile_id > 1")) == [2, 4]


COMPARED = (
    "user_profile_id bigint, risk_level string, pgl_reached_month date, lro_reached_month date, "
    "lttw_reached_month date, ltto_reached_month date"
)


def test_reports_on_the_comparison(frame):
    table = frame(COMPARED, [
        (1, "LOW", JAN, JAN, FEB, FEB), (2, "LOW", JAN, JAN, JAN, FEB), (3, None, None, JAN, JAN, JAN),
        (4, "LOW", JAN, None, FEB, None), (5, "LOW", JAN, None, MAR, MAR),
    ])
    assert users(compare.rule_disagreement(table)) == [1, 5]
    assert users(compare.rule_disagreement(table, rows=1)) == [1]
    assert users(compare.rule_gap(table)) == [3]
    assert users(compare.rule_gap(table, "lttw_reached_month")) == [3]
    assert rows_of(compare.rule_counts(table)) == [(4, 5, 4)]


def test_month_reports(frame):
    months = frame(MONTHS, [("LOW", 1, FEB), (None, 2, FEB), ("HIGH", 3, FEB), ("LOW", 4, JAN), ("HIGH", 1, FEB)])
    assert [tuple(r) for r in reports.count_by_month(months).collect()] == [
        (JAN, "LOW", 1), (FEB, "HIGH", 2), (FEB, "LOW", 1), (FEB, None, 1),
    ]
    assert [tuple(r) for r in reports.count_by_month(months, since=FEB).collect()][0] == (FEB, "HIGH", 2)
    assert rows_of(reports.first_month(months)) == [(JAN,)]
    assert rows_of(reports.ambiguous_users(months)) == [(1, 2, 1)]
    assert rows_of(reports.count_users(months)) == [(4,)]


def test_preview_has_a_total_order(frame):
    df = frame("a bigint, b string", [(2, "x"), (1, "z"), (1, "y"), (None, "w")])
    assert [tuple(r) for r in reports.preview(df, ["a"], 3).collect()] == [(1, "y"), (1, "z"), (2, "x")]
