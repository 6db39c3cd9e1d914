"""Rule back-test: old lifetime rule against the new risk-window rule."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.config import LimitConfig, SkewPolicy
from limitline.operators import compare, limits, outcomes, rates, reports, volumes
from limitline.operators.payments import FACT_KEYS, payments_entitlement
from limitline.operators.skew import hot_keys, materialise
from limitline.functions.time import at
from limitline.plans import stored
from limitline.sources.versions import VersionedTable
from limitline.sources.tables import Sources, bucketed_table, replace_table


class Backtest:
    """Every table of the back-test, each a lazy DataFrame.

    From the payments on, all steps are keyed by customer and share one exchange.
    """

    def __init__(
        self,
        src: Sources,
        config: LimitConfig = LimitConfig(),
        policy: SkewPolicy = SkewPolicy(),
    ):
        self.src, self.config, self.policy = src, config, policy

    @cached_property
    def hot(self) -> dict[str, list]:
        return hot_keys(self.src.report_action_step, *FACT_KEYS, policy=self.policy)

    def rates(self) -> DataFrame:
        return rates.to_eur_rates(self.src.daily_aggregated_rates, self.config.eur_currency_id)

    @cached_property
    def payments(self) -> DataFrame:
        """The dataset all rules start from, written once if a customer is hot."""
        rows = payments_entitlement(self.src, self.config, self.policy, self.hot)
        return materialise(rows) if self.hot["user_profile_id"] else rows

    def store_payments(self, path: str) -> None:
        """Write the payments once; whatever is asked for next reads that table."""
        self.payments = replace_table(self.payments, path)

    def bucket_payments(self, name: str, path: str, buckets: int = 200) -> None:
        """Store the payments in buckets by customer: no later step exchanges them again."""
        keys, order = [volumes.USER], [volumes.TIME]
        self.payments = bucketed_table(self.payments, name, keys, order, buckets, path)
        self.hot = {key: found.uncounted() for key, found in self.hot.items()}

    def single_payment_hit(self) -> DataFrame:
        return limits.single_payment_hit(self.payments, self.config)

    def single_payment_report(self) -> DataFrame:
        return reports.count_by_month(
            self.single_payment_hit(), "date_limit_reached", "profile_id",
            self.config.report_months_since,
        )

    @cached_property
    def volumes(self) -> DataFrame:
        return volumes.rolling_volumes_grouped(
            self.payments, self.config.windows, hot=self.hot["user_profile_id"], policy=self.policy
        )

    def volume_by_risk(self) -> DataFrame:
        return volumes.volume_by_risk(self.volumes, self.config)

    def limit_date_new(self) -> DataFrame:
        return limits.limit_date(self.volume_by_risk(), "volume_at_day", limit=self.config.limit)

    def limit_date_old(self) -> DataFrame:
        return limits.limit_date(self.volumes, "lifetime_volume", limit=self.config.limit)

    def _month(self, dates: DataFrame, preconditions: bool) -> DataFrame:
        if not preconditions:
            return limits.month_hit(dates, self.config)
        return limits.month_hit(
            dates, self.config,
            self.src.profiles_verified_borderless_ltv, self.src.receive_and_plastic_users_sm,
        )

    def volume_check(self) -> DataFrame:
        return volumes.volume_check(self.payments, self.hot["user_profile_id"], self.policy)

    def refreshed_old_rule_month(self, root: str, since: datetime) -> DataFrame:
        """``old_rule_month`` as a stored table: built from the payments before ``since``,
        then brought up to date for the customers that paid later."""
        hot, limit = self.hot["user_profile_id"], self.config.limit
        table = VersionedTable(self.payments.sparkSession, root)

        def months(payments: DataFrame) -> DataFrame:
            grouped = volumes.rolling_volumes_grouped(payments, self.config.windows, hot=hot, policy=self.policy)
            return limits.month_hit(limits.limit_date(grouped, "lifetime_volume", limit=limit), self.config)

        stored.store_months(table, months(self.payments.where(F.col(volumes.TIME) < at(since))))
        late = self.payments.where(F.col(volumes.TIME) >= at(since)).select(volumes.USER).distinct()
        stored.refresh_months(table, months(self.payments.join(late, volumes.USER, "left_semi")), late)
        return table.read()

    def released_users_not_in(self) -> DataFrame:
        """``released_users`` as written: NOT IN over the two month tables."""
        return compare.released_users(self.old_rule_month(), self.new_rule_month())

    def old_rule_month(self, preconditions: bool = False) -> DataFrame:
        return self._month(self.limit_date_old(), preconditions)

    def new_rule_month(self, preconditions: bool = False) -> DataFrame:
        return self._month(self.limit_date_new(), preconditions)

    def first_rule_month(self) -> DataFrame:
        return reports.first_month(self.new_rule_month())

    def ambiguous_users(self) -> DataFrame:
        return reports.ambiguous_users(self.old_rule_month())

    def new_rule_report(self) -> DataFrame:
        return reports.count_by_month(self.new_rule_month())

    def old_rule_report(self) -> DataFrame:
        return reports.count_by_month(self.old_rule_month())

    def released_users(self) -> DataFrame:
        return compare.released_from_months(compare.backtest_months(self.volumes, self.config))

    @cached_property
    def _hot_transfers(self) -> list:
        found = hot_keys(self.src.fraud_looker_transfers, "user_profile_id", policy=self.policy)
        return found["user_profile_id"]

    def suspension_rate(self) -> DataFrame:
        return outcomes.suspension_rate(
            self.released_users(), self.src.fraud_looker_transfers,
            self.src.fraud_models_predictions_and_scores,
            self.config, self._hot_transfers, self.policy,
        )

    def fraud_rate(self) -> DataFrame:
        return outcomes.fraud_rate(
            self.released_users(), self.src.fraud_looker_transfers, self.src.fraud_metrics,
            self.src.fraud_models_predictions_and_scores,
            self.config, self._hot_transfers, self.policy,
        )
