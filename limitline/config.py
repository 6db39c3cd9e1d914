"""Every constant the operators use, as frozen dataclasses with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

# Results are only right with exactly these.
BUSINESS_CLASS = "com.transferwise.fx.user.BusinessUserProfile"
PERSONAL_PATTERN = "%personal%"
RISK_WINDOWS = {"LOW": 90, "MEDIUM": 135, "HIGH": 180}
LIMIT_CURRENCIES = (
    "EUR", "CHF", "HUF", "RON", "BGN", "UAH", "RUB", "GEL",
    "HRK", "PLN", "SEK", "NOK", "DKK", "AUD", "HKD", "GBP",
)
EXCLUDED_STATES = (
    "CANCELED_WITHOUT_REFUND", "REFUNDED", "CHARGEDBACK_WITH_LOSS",
    "CHARGEDBACK_WITHOUT_LOSS", "CANCELED_WITH_REFUND",
)
OTHER_ENTITY_COUNTRIES = (
    "afg", "ala", "alb", "aus", "bel", "vgb", "bdi", "can", "caf", "tcd",
    "hkg", "cog", "cod", "cub", "eri", "ind", "irn", "irq", "jpn", "lby",
    "nzl", "pse", "sgp", "som", "ssd", "sdn", "syr", "usa", "umi",
)

# Decimal types that keep EUR arithmetic exact (no silent scale loss at 38 digits): an
# amount times a rate is decimal(37,17).
RATE_TYPE = "decimal(20,14)"
AMOUNT_TYPE = "decimal(16,3)"
EUR_TYPE = "decimal(18,8)"
VOLUME_TYPE = "decimal(24,8)"
TIES_TYPE = "decimal(13,0)"


@dataclass(frozen=True)
class LimitConfig:
    """Rule parameters; the defaults reproduce the published rules."""

    limit: int = 1000
    risk_windows: dict[str, int] = field(default_factory=lambda: dict(RISK_WINDOWS))
    currencies: tuple[str, ...] = LIMIT_CURRENCIES

    eur_currency_id: int = 1
    business_class: str = BUSINESS_CLASS
    personal_pattern: str = PERSONAL_PATTERN
    excluded_states: tuple[str, ...] = EXCLUDED_STATES
    other_entity_countries: tuple[str, ...] = OTHER_ENTITY_COUNTRIES
    us_country: str = "usa"

    sendmoney: str = "SENDMONEY"
    balance: str = "BALANCE"
    us_currency: str = "USD"
    entitlement_profiles_since: datetime = datetime(2016, 1, 1)
    entitlement_payments_since: datetime = datetime(2016, 1, 1)
    monitoring_submitted_since: datetime = datetime(2019, 1, 1)

    report_months_since: date = date(2019, 1, 1)
    default_cutoff: datetime = datetime(2021, 1, 1)

    outcomes_since: datetime = datetime(2019, 1, 1)
    outcome_limit_gbp: int = 1000
    balance_method: str = "balance"
    transferred_state: str = "TRANSFERRED"

    lifetime_entitlement: str = "97"
    payment_entitlement: str = "2"
    lifetime_verified_since: datetime = datetime(2018, 8, 1)
    lifetime_triggered_since: datetime = datetime(2019, 8, 1)
    payment_until: datetime = datetime(2019, 8, 1)
    verified_days_before: int = 1
    verified_days_after: int = 7
    triggered_since: datetime = datetime(2019, 1, 1)

    checked_customer: int = 359
    disagreement_rows: int = 100

    @property
    def windows(self) -> tuple[int, ...]:
        """Distinct trailing-window lengths in days, ascending."""
        return tuple(sorted(set(self.risk_windows.values())))


@dataclass(frozen=True)
class SkewPolicy:
    """When a key counts as hot, how far it is spread, what may be broadcast.

    ``key_places`` are the counters of the search for hot keys; up to ``max_hot_keys``
    hot keys stay in the plan, more are stored. ``task_rows`` is how many payments are
    dealt to one task.
    """

    hot_rows: int = 1_000_000
    key_places: int = 1 << 16
    max_hot_keys: int = 10_000
    salts: int = 256
    broadcast_rows: int = 1_000_000
    task_rows: int = 100_000
