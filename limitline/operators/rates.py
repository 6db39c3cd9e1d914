"""Daily exchange rates to EUR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.config import RATE_TYPE

#: Quotes without a day match nothing; they are spread instead of gathered as one day.
_SPREAD = "if(currency_date is null, pmod(xxhash64(from_currency_code, rate), 64), 0)"


def _is_eur(eur_id: int) -> str:
    return f"from_currency_id = {eur_id} and currency_date is not null"


def to_eur_rates(rates: DataFrame, eur_id: int = 1) -> DataFrame:
    """Rate to EUR per currency and day, through the common quote currency.

    Each quote meets every EUR quote of its day, gathered in one exchange: a day has as
    many quotes as there are currencies. Days without a EUR quote stay, with NULL date and rate.
    """
    days = rates.groupBy("currency_date", F.expr(_SPREAD)).agg(
        F.expr("collect_list(struct(from_currency_code as source_currency, rate)) as quotes"),
        F.expr(f"collect_list(if({_is_eur(eur_id)}, struct(inverse_exchange_rate), null)) as eur"),
    )
    return (
        days.select("currency_date", F.explode("quotes").alias("quote"), "eur")
        .select("currency_date", "quote.*", F.explode_outer("eur").alias("eur"))
        .selectExpr(
            "source_currency",
            "if(eur is null, null, currency_date) as currency_date",
            f"cast(eur.inverse_exchange_rate * rate as {RATE_TYPE}) as exch_rate",
        )
    )


def count_eur_rates(rates: DataFrame, eur_id: int = 1) -> int:
    """The number of rows of ``to_eur_rates``, from two counts per day."""
    days = rates.groupBy("currency_date").agg(
        F.expr("count(*) as quotes"), F.expr(f"count_if({_is_eur(eur_id)}) as eur")
    )
    return days.agg(F.expr("coalesce(sum(quotes * greatest(1, eur)), 0)")).first()[0]
