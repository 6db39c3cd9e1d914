"""Comparison of the four monitored rules per customer."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from limitline.config import LimitConfig, SkewPolicy
from limitline.operators import compare, limits, reports, volumes
from limitline.operators.payments import FACT_KEYS, payments_monitoring
from limitline.operators.skew import hot_keys, materialise
from limitline.sources.versions import VersionedTable
from limitline.sources.tables import Sources, bucketed_table, replace_table


class RuleComparison:
    """Every table of the comparison, each a lazy DataFrame.

    ``comparison`` computes all four rules from one scan of the payments and one
    exchange on the customer; the single-rule tables compute only what they show.
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

    @cached_property
    def payments(self) -> DataFrame:
        """The dataset all rules start from, written once if a customer is hot."""
        rows = payments_monitoring(self.src, self.config, self.policy, self.hot)
        return materialise(rows) if self.hot["user_profile_id"] else rows

    def store_payments(self, path: str) -> None:
        """Write the payments once; whatever is asked for next reads that table."""
        self.payments = replace_table(self.payments, path)

    def bucket_payments(self, name: str, path: str, buckets: int = 200) -> None:
        """Store the payments in buckets by customer: no later step exchanges them again."""
        keys, order = [volumes.USER], [volumes.TIME]
        self.payments = bucketed_table(self.payments, name, keys, order, buckets, path)
        self.hot = {key: found.uncounted() for key, found in self.hot.items()}

    def _volumes(self, form, *windows, distinct: bool) -> DataFrame:
        hot = self.hot["user_profile_id"]
        return form(self.payments, *windows, hot=hot, policy=self.policy, distinct=distinct)

    def linked_volumes(self, distinct: bool = True) -> DataFrame:
        return self._volumes(volumes.linked_volumes, distinct=distinct)

    def linked_window_volumes(self, distinct: bool = True) -> DataFrame:
        return self._volumes(
            volumes.linked_window_volumes, self.config.windows, distinct=distinct
        )

    def user_window_volumes(self, distinct: bool = True) -> DataFrame:
        return self._volumes(volumes.user_window_volumes, self.config.windows, distinct=distinct)

    def linked_window_snapshot(self, root: str) -> DataFrame:
        """A copy of ``linked_window_volumes``: stored as a table, cloned, read from the clone."""
        spark = self.payments.sparkSession
        table = VersionedTable(spark, f"{root}/linked_window_volumes")
        table.create(self.linked_window_volumes())
        return table.clone(f"{root}/linked_window_snapshot").read()

    def lttw_volume(self, distinct: bool = True) -> DataFrame:
        return volumes.volume_by_risk(self.linked_window_volumes(distinct), self.config)

    def ltto_volume(self, distinct: bool = True) -> DataFrame:
        return volumes.volume_by_risk(self.user_window_volumes(distinct), self.config)

    def limit_date(self, rule: str) -> DataFrame:
        """First date a rule is hit; repeated rows would not change a first date, so
        the volumes are not made distinct for it."""
        table, column = {
            "pgl": (self.linked_volumes, "lifetime_volume"),
            "lro": (self.linked_volumes, "same_recipient_volume"),
            "lttw": (self.lttw_volume, "volume_at_day"),
            "ltto": (self.ltto_volume, "volume_at_day"),
        }[rule]
        return limits.limit_date(table(distinct=False), column, limits.MONITORING_HIT_KEYS, self.config.limit)

    def month(self, rule: str) -> DataFrame:
        return limits.month_hit_eligible(self.limit_date(rule), self.config)

    def pgl_users(self) -> DataFrame:
        return reports.count_users(self.month("pgl"))

    def comparison(self) -> DataFrame:
        wide = self._volumes(volumes.monitoring_volumes, self.config.windows, distinct=False)
        return compare.compare_months(compare.monitoring_months(wide, self.config))

    def comparison_joined(self) -> DataFrame:
        """``comparison`` as written: a union of customers, joined with four month tables."""
        return compare.compare_rules(*(self.month(rule) for rule in compare.RULES))

    def rule_gap(self, column: str = "ltto_reached_month") -> DataFrame:
        return compare.rule_gap(self.comparison(), column)

    def rule_disagreement(self) -> DataFrame:
        return compare.rule_disagreement(self.comparison(), self.config.disagreement_rows)

    def rule_counts(self) -> DataFrame:
        return compare.rule_counts(self.comparison())
