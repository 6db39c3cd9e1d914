"""Contracts, rates, payments, outcomes and entitlements on small inputs."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from conftest import rows_of, when

from limitline.config import BUSINESS_CLASS, LimitConfig
from limitline.operators import entitlements, outcomes
from limitline.operators.payments import payments_entitlement, payments_monitoring
from limitline.operators.rates import to_eur_rates
from limitline.operators.reports import customer_total
from limitline.sources.schemas import SCHEMAS, conform
from limitline.sources.star_schema import PERSONAL_CLASS
from limitline.sources.tables import Sources, replace_table, snapshot

DAY = date(2020, 5, 1)


@pytest.mark.parametrize("kind,values", [("boolean", [True, False, None]), ("int", [1, 0, None]), ("bigint", [1, 2, None])])
def test_flags_become_boolean(frame, kind, values):
    df = conform(frame(f"request_id int, NEEDS_REVIEW {kind}", [(1, v) for v in values]),
                 "fraud_models_predictions_and_scores")
    assert df.schema.simpleString() == "struct<request_id:bigint,needs_review:boolean>"
    assert [r.needs_review for r in df.collect()] == [True, False, None]


def test_missing_column_is_an_error(frame):
    with pytest.raises(ValueError, match="needs_review"):
        conform(frame("request_id int", []), "fraud_models_predictions_and_scores")


def test_tables_are_stored_and_copied(spark, frame, tmp_path):
    df = frame("request_id bigint", [(1,), (2,)])
    path = str(tmp_path / "fraud_metrics.parquet")
    replace_table(frame("request_id bigint", [(9,)]), path)
    assert rows_of(replace_table(df, path)) == [(1,), (2,)]
    assert rows_of(Sources.from_parquet(spark, str(tmp_path)).fraud_metrics) == [(1,), (2,)]
    copy = str(tmp_path / "copy")
    assert rows_of(snapshot(df, copy)) == [(1,), (2,)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        snapshot(df, copy)


def test_catalog_tables_and_unknown_names(spark, frame):
    frame("request_id bigint", [(5,)]).createOrReplaceTempView("some_fraud")
    src = Sources.from_catalog(spark, {"fraud_metrics": "some_fraud"})
    assert rows_of(src.fraud_metrics) == [(5,)]
    with pytest.raises(AttributeError):
        src.no_such_table


def quote(currency_id, code, day, rate, inverse):
    return (currency_id, code, day, Decimal(rate), Decimal(inverse))


def test_rates_keep_days_without_a_eur_quote(frame):
    rates = frame(SCHEMAS["daily_aggregated_rates"], [
        quote(1, "EUR", DAY, "0.8", "1.25"), quote(3, "USD", DAY, "0.7", "1.4"),
        quote(3, "USD", date(2020, 5, 2), "0.7", "1.4"), quote(1, "EUR", None, "0.8", "1.25"),
    ])
    assert rows_of(to_eur_rates(rates)) == [
        ("EUR", DAY, Decimal("1")), ("EUR", None, None), ("USD", DAY, Decimal("0.875")), ("USD", None, None),
    ]


def test_rates_repeat_for_repeated_eur_quotes(frame):
    rates = frame(SCHEMAS["daily_aggregated_rates"], [
        quote(1, "EUR", DAY, "0.8", "1.25"), quote(1, "EUR", DAY, "0.8", "1.25"), quote(3, "USD", DAY, "0.7", "1.4"),
    ])
    assert to_eur_rates(rates).count() == 6


@pytest.fixture
def source(frame):
    """Sources with one good payment; every argument replaces or adds table rows."""

    def build(**tables):
        rows = {
            "daily_aggregated_rates": [quote(1, "EUR", DAY, "0.8", "1.25"), quote(3, "USD", DAY, "0.7", "1.4")],
            "report_action_step": [step(1, 100)],
            "transfer": [(100, 1, 7, "TRANSFERRED")],
            "user_profile": [(1, PERSONAL_CLASS, when("2017-01-01"), 50)],
            "user_profile_address": [(50, "deu")],
            "user_profile_risk_score_level": [(1, "LOW")],
            "lookup_request_history": [(100, when("2020-04-30"))],
            **tables,
        }
        return Sources.from_frames({t: frame(SCHEMAS[t], rows.get(t, [])) for t in SCHEMAS})

    return build


def step(user, request, time="2020-05-01T10:00:00", currency="USD", local="200.00", flag=True, product="SENDMONEY"):
    return (user, request, when(time), currency, Decimal(local) if local else None, Decimal("10"), flag, product)


def test_a_good_payment(source):
    assert rows_of(payments_entitlement(source()), "user_profile_id", "target_recipient_id", "risk_level",
                   "invoice_value_eur") == [(1, 7, "LOW", Decimal("175"))]
    assert rows_of(payments_monitoring(source()), "invoice_value_eur", "has_us_address", "tw_ltd_customer") == [
        (Decimal("175"), False, True)
    ]


@pytest.mark.parametrize(
    "tables",
    [
        {"report_action_step": [step(1, 100, flag=False)]},
        {"report_action_step": [step(1, 100, product="CARD")]},
        {"report_action_step": [step(1, 100, local=None)]},
        {"report_action_step": [step(1, 100, time="2020-05-02")]},
        {"report_action_step": [step(1, 100, currency="GBP")]},
        {"transfer": [(100, 1, 7, "REFUNDED")]},
        {"transfer": [(100, 1, 7, None)]},
        {"transfer": [(101, 1, 7, "SENT")]},
        {"user_profile": [(1, BUSINESS_CLASS, when("2017-01-01"), 50)]},
        {"user_profile": [(1, None, when("2017-01-01"), 50)]},
    ],
)
def test_payments_that_do_not_count(source, tables):
    src = source(**tables)
    assert payments_entitlement(src).count() == 0
    assert payments_monitoring(src).count() == 0


def test_dataset_specific_conditions(source):
    new_profile = source(user_profile=[(1, PERSONAL_CLASS, when("2015-12-31"), 50)])
    assert (payments_entitlement(new_profile).count(), payments_monitoring(new_profile).count()) == (0, 1)
    balance = source(report_action_step=[step(1, 100, product="BALANCE")])
    assert (payments_entitlement(balance).count(), payments_monitoring(balance).count()) == (0, 1)
    late = source(lookup_request_history=[(100, when("2020-05-01T10:00:00.000001"))])
    assert (payments_entitlement(late).count(), payments_monitoring(late).count()) == (1, 0)
    early = source(lookup_request_history=[(100, when("2018-12-31T23:59:59"))])
    assert payments_monitoring(early).count() == 0


@pytest.mark.parametrize("country,us,tw", [("usa", True, False), ("aus", False, False), ("deu", False, True), (None, False, False)])
def test_address_flags(source, country, us, tw):
    src = source(user_profile_address=[(50, country)])
    assert rows_of(payments_monitoring(src), "has_us_address", "tw_ltd_customer") == [(us, tw)]


def test_missing_address_and_risk(source):
    src = source(user_profile_address=[], user_profile_risk_score_level=[])
    assert rows_of(payments_monitoring(src), "has_us_address", "tw_ltd_customer", "risk_level") == [(False, False, None)]


def test_customer_total(source):
    src = source(report_action_step=[step(1, 100), step(1, 101, product="CARD"), step(1, 102, flag=False), step(2, 103)])
    assert rows_of(customer_total(src.report_action_step, 1)) == [(Decimal("20"),)]
    assert rows_of(customer_total(src.report_action_step, 5)) == [(None,)]


# ---- outcomes

def moved(user, request, time, gbp="10", state="TRANSFERRED", method="card", engine=False):
    return (user, request, when(time), Decimal(gbp), state, method, engine)


@pytest.fixture
def outcome(frame):
    def build(transfers, scores=(), fraud=(), users=((1,),)):
        return (
            frame("user_profile_id bigint", list(users)),
            frame(SCHEMAS["fraud_looker_transfers"], list(transfers)),
            frame(SCHEMAS["fraud_metrics"], [(f,) for f in fraud]),
            frame(SCHEMAS["fraud_models_predictions_and_scores"], list(scores)),
        )

    return build


def test_suspension_rate(outcome):
    users, transfers, _, scores = outcome(
        [
            moved(1, 1, "2019-01-05"), moved(1, 1, "2019-01-06"), moved(1, 2, "2019-01-07"), moved(1, 3, "2019-02-01"),
            moved(1, 4, "2018-12-31"), moved(1, 5, "2019-01-01", gbp="1000"), moved(2, 6, "2019-01-01"),
            moved(1, None, "2019-03-01"),
        ],
        scores=[(1, True), (1, False), (2, False), (2, None), (5, True), (6, True)],
        users=[(1,), (1,)],
    )
    got = [tuple(r) for r in outcomes.suspension_rate(users, transfers, scores).collect()]
    assert got == [(date(2019, 3, 1), None, 0), (date(2019, 2, 1), None, 0), (date(2019, 1, 1), 0.5, 1)]


def test_fraud_rate(outcome):
    users, transfers, fraud, scores = outcome(
        [
            moved(1, 1, "2019-01-05", engine=True), moved(1, 2, "2019-01-06", method=None),
            moved(1, 3, "2019-01-06", state="CANCELLED"), moved(1, 4, "2019-01-06", method="balance"),
            moved(1, 5, "2019-01-06", gbp="1000"), moved(1, 6, "2019-01-06", gbp="1000.01"),
            # no fraud: kept, without a rate
            moved(1, 7, "2019-02-05", engine=True),
            # no scored transfer, no engine-suspended transfer, only a request without an id: dropped
            moved(1, 8, "2019-03-05", engine=True), moved(1, 9, "2019-04-05"), moved(1, None, "2019-05-05", engine=True),
        ],
        scores=[(1, False), (7, True), (9, False)],
        fraud=[2, 2, 3, 4, 6, 9],
    )
    got = [tuple(r) for r in outcomes.fraud_rate(users, transfers, fraud, scores).collect()]
    assert got == [(date(2019, 2, 1), None, 0), (date(2019, 1, 1), pytest.approx(2 / 3), 2)]


# ---- entitlements

@pytest.mark.parametrize(
    "offset,found",
    [
        (timedelta(days=-1), False),
        (timedelta(days=-1, microseconds=1), True),
        (timedelta(0), True),
        (timedelta(days=7), True),
        (timedelta(days=7, microseconds=1), False),
    ],
)
@pytest.mark.parametrize("trigger", ["2020-05-01T12:00:00", "1969-12-28T00:00:00", "2020-05-08T23:59:59.999999"])
def test_verifications_around_a_trigger(frame, trigger, offset, found):
    triggers = frame("user_profile_id bigint, date_created timestamp_ntz", [(1, when(trigger))])
    history = frame(SCHEMAS["profile_verification_history_sm"], [(1, "SELFIE", when(trigger) + offset), (2, "BANK", when(trigger))])
    got = entitlements.verified_near(triggers, history, 1, 7)
    assert rows_of(got, "user_profile_id", "verification_method") == [(1, "SELFIE" if found else None)]


def test_every_verification_counts_once(frame):
    start = when("2020-01-01")
    triggers = frame("user_profile_id bigint, date_created timestamp_ntz", [(1, start + timedelta(hours=5 * i)) for i in range(60)])
    history = frame(SCHEMAS["profile_verification_history_sm"], [(1, "BANK", start + timedelta(hours=7 * i)) for i in range(60)])
    expected = 0
    for i in range(60):
        matches = sum(-24 < 7 * j - 5 * i <= 168 for j in range(60))
        expected += max(matches, 1)
    assert entitlements.verified_near(triggers, history, 1, 7).count() == expected


def test_entitlement_tables(source):
    src = source(
        transfer=[(100, 1, 7, "SENT"), (101, 2, 7, "SENT"), (102, 3, 7, "SENT")],
        user_profile=[(1, "x.PERSONALx", when("2017-01-01"), 50), (2, BUSINESS_CLASS, when("2017-01-01"), 50),
                      (3, PERSONAL_CLASS, when("2017-01-01"), 50)],
        triggered_entitlement=[
            (100, when("2019-08-15"), "97"), (101, when("2019-08-15"), "97"), (102, when("2018-08-01"), "97"),
            (102, when("2019-07-31T23:59:59"), "2"), (102, when("2019-08-01"), "2"), (999, when("2019-08-15"), "97"),
        ],
        profile_verification_history_sm=[(1, "SELFIE", when("2019-08-16")), (1, "BANK", when("2019-08-17"))],
    )
    cfg = LimitConfig()
    verified = entitlements.entitlement_verified(src, "97", since=cfg.lifetime_verified_since)
    assert rows_of(verified, "profile_id", "entitlement_month", "verification_method", "risk_level") == [
        (1, date(2019, 8, 1), "BANK", "LOW"), (1, date(2019, 8, 1), "SELFIE", "LOW"), (3, date(2018, 8, 1), None, None),
    ]
    triggered = entitlements.entitlement_triggered(src, "97", since=cfg.lifetime_triggered_since)
    assert rows_of(triggered, "profile_id") == [(1,)]
    assert rows_of(entitlements.entitlement_triggered(src, "2", until=cfg.payment_until)) == [(3, date(2019, 7, 1), None)]
    assert rows_of(entitlements.triggered_users(src)) == [(3,)]


def test_small_rates_keep_their_digits(spark):
    """HUF 397,500 at these rates are 999.91 EUR: no limit hit."""
    from decimal import Decimal

    from limitline.operators.rates import to_eur_rates
    from limitline.sources.schemas import conform

    rows = [(1, "EUR", "2020-01-01", "1", "1.17"), (9, "HUF", "2020-01-01", "0.00215", "1"), (8, "VND", "2020-01-01", "0.0000331", "1")]
    quotes = spark.createDataFrame(rows, "from_currency_id int, from_currency_code string, d string, r string, i string")
    quotes = quotes.selectExpr(
        "from_currency_id", "from_currency_code", "cast(d as date) as currency_date",
        "cast(r as decimal(18,10)) as rate", "cast(i as decimal(18,10)) as inverse_exchange_rate",
    )
    rates = to_eur_rates(conform(quotes, "daily_aggregated_rates"))
    found = {r["source_currency"]: r["exch_rate"] for r in rates.collect()}
    assert found["HUF"] == Decimal("0.0025155") and found["VND"] == Decimal("0.000038727")
    assert 397_500 * found["HUF"] < 1000


def test_lost_digits_are_an_error(spark):
    import pytest as _pytest

    from limitline.sources.schemas import conform

    quotes = spark.sql(
        "select 1 as from_currency_id, 'EUR' as from_currency_code, date'2020-01-01' as currency_date, "
        "cast('0.0000000000001' as decimal(20,13)) as rate, cast(1 as decimal(20,12)) as inverse_exchange_rate"
    )
    with _pytest.raises(Exception, match="more digits"):
        conform(quotes, "daily_aggregated_rates").collect()
