"""Column expressions shared by the limit rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from limitline.config import TIES_TYPE, VOLUME_TYPE, LimitConfig


def window_column(days: int) -> str:
    return f"last_{days}d_volume"


def text_list(values: Iterable[str]) -> str:
    """``('a', 'b')`` for an IN predicate."""
    return "(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def listed(column: str, values: Iterable) -> Column:
    """Whether the column is one of the values (texts or whole numbers).

    One SQL text instead of ``isin``, which makes a call to the JVM per value.
    """
    values = list(values)
    if all(isinstance(v, int) for v in values):
        return F.expr(f"`{column}` in ({', '.join(map(str, values))})")
    return F.expr(f"`{column}` in {text_list(values)}")


def risk_volume(config: LimitConfig, prefix: str = "") -> Column:
    """Trailing-window volume picked by ``risk_level``; NULL for any other level."""
    arms = " ".join(
        f"when '{risk}' then {prefix}{window_column(days)}"
        for risk, days in config.risk_windows.items()
    )
    return F.expr(f"case risk_level {arms} end")


def eligible(config: LimitConfig) -> Column:
    """Whether the payment that hit the limit counts for this entity.

    Send-money payments are assigned by currency (USD by address), balance payments by
    address. Any other product gives NULL, which a filter drops.
    """
    by_currency = (
        f"if(source_currency = '{config.us_currency}', not has_us_address, "
        f"source_currency in {text_list(config.currencies)})"
    )
    return F.expr(
        f"case product_type when '{config.sendmoney}' then {by_currency}"
        f" when '{config.balance}' then tw_ltd_customer end"
    )


def times(volume: str, ties: str) -> Column:
    """Exact ``volume * ties``: 24 + 13 + 1 digits fill decimal(38,8) without loss."""
    return F.expr(f"cast({volume} as {VOLUME_TYPE}) * cast({ties} as {TIES_TYPE})")
