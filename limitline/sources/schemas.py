"""Columns and types of the fourteen source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "daily_aggregated_rates": (
        "from_currency_id int, from_currency_code string, currency_date date, "
        "rate decimal(20,12), inverse_exchange_rate decimal(20,12)"
    ),
    "report_action_step": (
        "user_profile_id bigint, request_id bigint, action_creation_time timestamp_ntz, "
        "source_currency string, invoice_value_local decimal(16,3), "
        "invoice_value_gbp decimal(18,6), flag_for_aggregations boolean, product_type string"
    ),
    "transfer": "id bigint, user_profile_id bigint, target_recipient_id bigint, state string",
    "user_profile": "id bigint, class string, date_created timestamp_ntz, address_id bigint",
    "user_profile_address": "id bigint, country_code string",
    "user_profile_risk_score_level": "user_profile_id bigint, risk_level string",
    "lookup_request_history": "request_id bigint, first_success_submit_date timestamp_ntz",
    "profiles_verified_borderless_ltv": "user_profile_id bigint, dateoflimit timestamp_ntz",
    "receive_and_plastic_users_sm": (
        "profile_id bigint, account_details_order_time timestamp_ntz, card_order_time timestamp_ntz"
    ),
    "fraud_looker_transfers": (
        "user_profile_id bigint, request_id bigint, action_creation_time timestamp_ntz, "
        "invoice_value_gbp decimal(18,6), action_state string, payment_method string, "
        "engine_suspend_flag boolean"
    ),
    "fraud_models_predictions_and_scores": "request_id bigint, needs_review boolean",
    "fraud_metrics": "request_id bigint",
    "triggered_entitlement": (
        "request_id bigint, date_created timestamp_ntz, entitlement_id string"
    ),
    "profile_verification_history_sm": (
        "user_profile_id bigint, verification_method string, first_verification_time timestamp_ntz"
    ),
}


#: The partition column of payments that are stored by day, kept where it is there.
DAY = "payment_day"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the columns of ``table`` with their declared types.

    Flags may arrive as boolean or as 0/1 and leave as boolean. A missing column is an
    error here, not a surprise in a later join; so is, when read, a decimal with more
    digits than its type has.
    """
    wanted = T.StructType.fromDDL(SCHEMAS[table])
    have = {field.name.lower(): field for field in df.schema.fields}
    missing = [f.name for f in wanted if f.name not in have]
    if missing:
        raise ValueError(f"{table} lacks the columns {missing}")

    def column(field: T.StructField) -> str:
        source = have[field.name]
        name, kind = f"`{source.name}`", field.dataType
        if source.dataType == kind:
            value = name
        elif isinstance(kind, T.BooleanType):
            value = f"{name} = 1"
        else:
            value = f"cast({name} as {kind.simpleString()})"
            if isinstance(kind, T.DecimalType) and isinstance(source.dataType, T.DecimalType):
                lost = f"raise_error('{table}.{field.name} has more digits than {kind.simpleString()}')"
                value = f"if({value} <> {name}, {lost}, {value})"
        return f"{value} as {field.name}"

    kept = [DAY] if table == "report_action_step" and DAY in have else []
    return df.selectExpr(*map(column, wanted), *kept)
