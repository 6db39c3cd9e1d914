"""Independent extracts: triggered entitlements and single checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from limitline.config import LimitConfig, SkewPolicy
from limitline.operators import entitlements, reports
from limitline.operators.skew import hot_keys
from limitline.sources.tables import Sources


class Extracts:
    """The four entitlement tables and two checks, each a lazy DataFrame."""

    def __init__(
        self,
        src: Sources,
        config: LimitConfig = LimitConfig(),
        policy: SkewPolicy = SkewPolicy(),
    ):
        self.src, self.config, self.policy = src, config, policy

    @cached_property
    def hot(self) -> dict[str, list]:
        return {
            **hot_keys(self.src.triggered_entitlement, "request_id", policy=self.policy),
            **hot_keys(self.src.transfer, "user_profile_id", policy=self.policy),
        }

    def _shared(self) -> dict:
        return {"config": self.config, "policy": self.policy, "hot": self.hot}

    @cached_property
    def _verified(self) -> dict:
        busy = entitlements.hot_verified(self.src, self.hot, self.policy)
        return self._shared() | {"hot": self.hot | {"verified_user": busy}}

    def lifetime_verified(self) -> DataFrame:
        return entitlements.entitlement_verified(
            self.src, self.config.lifetime_entitlement,
            since=self.config.lifetime_verified_since, **self._verified,
        )

    def lifetime_triggered(self) -> DataFrame:
        return entitlements.entitlement_triggered(
            self.src, self.config.lifetime_entitlement,
            since=self.config.lifetime_triggered_since, **self._shared(),
        )

    def payment_verified(self) -> DataFrame:
        return entitlements.entitlement_verified(
            self.src, self.config.payment_entitlement,
            until=self.config.payment_until, **self._verified,
        ).drop("entitlement_id")

    def payment_triggered(self) -> DataFrame:
        return entitlements.entitlement_triggered(
            self.src, self.config.payment_entitlement,
            until=self.config.payment_until, **self._shared(),
        )

    def triggered_users(self) -> DataFrame:
        return entitlements.triggered_users(self.src, self.config.triggered_since)

    def customer_total(self, user: int | None = None) -> DataFrame:
        return reports.customer_total(
            self.src.report_action_step, self.config.checked_customer if user is None else user
        )
