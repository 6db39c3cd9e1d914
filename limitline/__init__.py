"""Payment-limit analytics as Spark DataFrame operators."""

from limitline.config import LimitConfig, SkewPolicy
from limitline.plans.backtest import Backtest
from limitline.plans.comparison import RuleComparison
from limitline.plans.extracts import Extracts
from limitline.sources.tables import Sources

__all__ = [
    "Backtest",
    "Extracts",
    "LimitConfig",
    "RuleComparison",
    "SkewPolicy",
    "Sources",
]
