"""The source tables derived from the ``orders`` and ``customer`` test tables.

Order dates move 20 years ahead, so that the default dates of the rules apply. The
derivations are those of FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from limitline.config import BUSINESS_CLASS
from limitline.operators.skew import dealt, parts
from limitline.sources.tables import Sources

PERSONAL_CLASS = BUSINESS_CLASS.replace("Business", "Personal")
CURRENCIES = {1: "EUR", 2: "GBP", 3: "USD", 4: "PLN", 5: "BRL"}

STAR_SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_extendedprice double",
}

TIME = "o_orderdate + interval 20 years"
AMOUNT = "cast(o_totalprice as decimal(14,2))"
QUOTED = ", ".join(f"struct({i} as id, '{code}' as code)" for i, code in CURRENCIES.items())


def _days_after(start: str, days: str) -> str:
    return f"cast(date_add(date '{start}', cast({days} as int)) as timestamp_ntz)"


def _shifted(unit: str, amount: str) -> str:
    """The order time moved by whole days or hours, without calendar or zone rules."""
    return f"{TIME} + cast({amount} as int) * interval '1' {unit}"


ORDER_TABLES: dict[str, tuple[str | None, Sequence[str]]] = {
    "report_action_step": (
        None,
        (
            "o_orderkey as request_id",
            "o_custkey as user_profile_id",
            f"{TIME} as action_creation_time",
            "case o_orderkey % 5 when 0 then 'EUR' when 1 then 'GBP' when 2 then 'USD' "
            "when 3 then 'PLN' else 'BRL' end as source_currency",
            "case o_orderpriority when '5-LOW' then 'CARD' when '4-NOT SPECIFIED' then 'BALANCE' "
            "else 'SENDMONEY' end as product_type",
            "if(o_orderkey % 10 = 0, 0, 1) as flag_for_aggregations",
            f"{AMOUNT} as invoice_value_local",
            f"{AMOUNT} * 0.0024 as invoice_value_gbp",
        ),
    ),
    "transfer": (
        None,
        (
            "o_orderkey as id",
            "o_custkey as user_profile_id",
            "if(o_orderkey % 11 = 0, null, o_orderkey % 3) as target_recipient_id",
            "case when o_orderstatus <> 'P' then 'TRANSFERRED' when o_orderkey % 6 = 0 then 'REFUNDED' "
            "when o_orderkey % 6 = 1 then 'CHARGEDBACK_WITH_LOSS' else 'SENT' end as state",
        ),
    ),
    "lookup_request_history": (
        None,
        (
            "o_orderkey as request_id",
            f"{_shifted('day', 'o_orderkey % 4 - 2')} as first_success_submit_date",
        ),
    ),
    "fraud_looker_transfers": (
        None,
        (
            "o_custkey as user_profile_id",
            "o_orderkey as request_id",
            f"{TIME} as action_creation_time",
            f"{AMOUNT} * 0.0024 as invoice_value_gbp",
            "if(o_orderstatus = 'P', 'CANCELLED', 'TRANSFERRED') as action_state",
            "case o_orderkey % 4 when 0 then 'balance' when 1 then 'card' when 2 then 'bank_transfer' "
            "end as payment_method",
            "if(o_orderkey % 9 = 0, 1, 0) as engine_suspend_flag",
        ),
    ),
    "fraud_models_predictions_and_scores": (
        "o_orderkey % 5 <> 0",
        ("o_orderkey as request_id", "if(o_orderkey % 8 = 0, 1, 0) as needs_review"),
    ),
    "fraud_metrics": ("o_orderkey % 37 = 0", ("o_orderkey as request_id",)),
    "triggered_entitlement": (
        "o_totalprice > 250000",
        (
            "o_orderkey as request_id",
            f"{_shifted('hour', 'o_orderkey % 24')} as date_created",
            "case o_orderkey % 4 when 0 then '2' when 1 then '97' else '13' end as entitlement_id",
        ),
    ),
    "profile_verification_history_sm": (
        "o_orderkey % 2 = 1",
        (
            "o_custkey as user_profile_id",
            "case o_orderkey % 3 when 0 then 'ID_DOCUMENT' when 1 then 'SELFIE' else 'BANK' end "
            "as verification_method",
            f"{_shifted('day', 'o_orderkey % 12 - 3')} as first_verification_time",
        ),
    ),
}

CUSTOMER_TABLES: dict[str, tuple[str | None, Sequence[str]]] = {
    "user_profile": (
        None,
        (
            "c_custkey as id",
            "c_custkey as address_id",
            f"if(c_mktsegment = 'MACHINERY', '{BUSINESS_CLASS}', '{PERSONAL_CLASS}') as class",
            f"{_days_after('2015-10-01', 'c_custkey % 400')} as date_created",
        ),
    ),
    "user_profile_address": (
        "c_custkey % 13 <> 0",
        (
            "c_custkey as id",
            "case c_nationkey % 5 when 0 then 'usa' when 1 then 'gbr' when 2 then 'aus' "
            "when 3 then 'deu' end as country_code",
        ),
    ),
    "user_profile_risk_score_level": (
        "c_custkey % 17 <> 0",
        (
            "c_custkey as user_profile_id",
            "case c_custkey % 4 when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' end "
            "as risk_level",
        ),
    ),
    "profiles_verified_borderless_ltv": (
        "c_custkey % 3 = 0",
        (
            "c_custkey as user_profile_id",
            f"{_days_after('2017-01-01', 'c_custkey % 1500')} as dateoflimit",
        ),
    ),
    "receive_and_plastic_users_sm": (
        "c_custkey % 4 <> 1",
        (
            "c_custkey as profile_id",
            f"if(c_custkey % 2 = 0, {_days_after('2018-01-01', 'c_custkey % 900')}, null) "
            "as account_details_order_time",
            f"if(c_custkey % 5 = 0, {_days_after('2018-06-01', 'c_custkey % 700')}, null) "
            "as card_order_time",
        ),
    ),
}


#: What the disputed variant adds or changes: rows that break the grain of three tables, and
#: payments taken back, so that the checks of ambiguity and of the rules' order have answers.
DISPUTED_AMOUNT = f"if(o_orderkey % 3 = 0, -{AMOUNT}, {AMOUNT}) as invoice_value_local"
DISPUTED_ROWS = {
    "lookup_request_history": ("o_orderkey % 50 = 0", ORDER_TABLES["lookup_request_history"][1]),
    "user_profile_risk_score_level": (
        "c_custkey % 10 = 0",
        (
            "c_custkey as user_profile_id",
            "case c_custkey % 4 when 0 then 'MEDIUM' when 1 then 'HIGH' else 'LOW' end as risk_level",
        ),
    ),
}


def read_star(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _daily_rates(orders: DataFrame) -> DataFrame:
    """Quotes of five currencies for every order day, none for EUR on the 13th."""
    return (
        orders.selectExpr(f"cast({TIME} as date) as currency_date")
        .distinct()
        .selectExpr("currency_date", f"inline(array({QUOTED}))")
        .filter("id <> 1 or day(currency_date) <> 13")
        .selectExpr(
            "id as from_currency_id",
            "code as from_currency_code",
            "currency_date",
            "cast(20 + 2 * id + day(currency_date) % 5 as decimal(9,0)) * 0.0001 as rate",
            "cast(110 + id + day(currency_date) % 3 as decimal(9,0)) * 0.01 as inverse_exchange_rate",
        )
    )


def from_star_schema(spark: SparkSession, sf_dir: str, disputed: bool = False) -> Sources:
    """Sources over ``<sf_dir>/orders.parquet`` and ``<sf_dir>/customer.parquet``.

    With ``disputed`` some keys are repeated and some payments are negative.
    """

    def of(table: str, where: str | None, columns: Sequence[str]) -> DataFrame:
        rows = read_star(spark, sf_dir, "orders" if table in ORDER_TABLES else "customer")
        return (rows.filter(where) if where else rows).selectExpr(*columns)

    def derive(table: str) -> DataFrame:
        if table == "daily_aggregated_rates":
            rates = _daily_rates(read_star(spark, sf_dir, "orders"))
            twice = "if(from_currency_id = 2 and day(currency_date) = 5, 2, 1)"
            return rates.selectExpr("*", f"explode(sequence(1, {twice})) as copy").drop("copy") if disputed else rates
        where, columns = {**ORDER_TABLES, **CUSTOMER_TABLES}[table]
        if disputed and table == "report_action_step":
            columns = [DISPUTED_AMOUNT if c.endswith("as invoice_value_local") else c for c in columns]
        rows = of(table, where, columns)
        return rows.unionByName(of(table, *DISPUTED_ROWS[table])) if disputed and table in DISPUTED_ROWS else rows

    return Sources(derive)


def tied_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with many ties: one per order line, at the date of the order."""
    lines = read_star(spark, sf_dir, "lineitem")
    orders = read_star(spark, sf_dir, "orders")
    lines = dealt(lines, parts(lines.count()), "l_orderkey")
    return lines.join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").selectExpr(
        "o_custkey as user_profile_id",
        "l_orderkey as request_id",
        "o_orderdate as action_creation_time",
        "'EUR' as source_currency",
        "'SENDMONEY' as product_type",
        "if(l_suppkey % 10 = 0, null, l_suppkey % 3) as target_recipient_id",
        "case o_custkey % 4 when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' end as risk_level",
        "cast(cast(l_extendedprice as decimal(14,2)) as decimal(18,8)) as invoice_value_eur",
        "false as has_us_address",
        "true as tw_ltd_customer",
    )
