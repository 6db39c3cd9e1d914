"""Lifetime and trailing-window payment volumes per customer.

The volume of the last ``d`` days is the running total up to now minus the running
total up to ``d`` days ago. Both are frames that start unbounded, so a customer costs
one sort and one linear pass, and "strictly later than ``d`` days ago" needs no
epsilon: what the second total leaves out is exactly what the window keeps.

A customer with very many payments would still be one task. Such hot customers take
another way to the same totals: equal payments are collapsed before the shuffle, and the
rest is cut into pieces at quantiles of (customer, time), so that no piece outgrows a task.
A customer inside one piece has all its totals there, from the same frames; for those that
go on over several pieces the totals are a distributed prefix sum (``prefix.running_totals``).
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.config import VOLUME_TYPE, LimitConfig, SkewPolicy
from limitline.functions.rules import risk_volume, times, window_column
from limitline.functions.time import DAY_US, micros
from limitline.operators.prefix import PIECE, running_totals
from limitline.operators.skew import HotKeys, dealt, hot_keys, parts, stored

USER = "user_profile_id"
RECIPIENT = "target_recipient_id"
TIME = "action_creation_time"
AMOUNT = "invoice_value_eur"
TIME_US = "time_us"

ENTITLEMENT_KEYS = ("source_currency", "risk_level")
MONITORING_KEYS = (
    "source_currency", "product_type", "risk_level", "has_us_address", "tw_ltd_customer",
)


def _total(expression: str) -> str:
    """Bring a sum back to the volume type: past 38 digits Spark would cut the scale."""
    return f"cast({expression} as {VOLUME_TYPE})"


def _totals(total_at, days: Sequence[int], lifetime: str, window: str) -> list[str]:
    """Lifetime and trailing volumes as SQL, from running totals ``total_at(d)``."""
    now = total_at(0)
    return [f"{_total(now)} as {lifetime}"] + [
        f"{_total(f'{now} - coalesce({total_at(d)}, 0)')} as {window}_{d}" for d in days
    ]


def _plain_volumes(payments: DataFrame, keys: Sequence[str], days: Sequence[int]) -> DataFrame:
    """One row per payment; a single exchange on the customer serves all windows."""
    rows = payments.select(
        USER, RECIPIENT, TIME, *keys,
        micros(TIME).alias(TIME_US),
        F.expr(f"coalesce({AMOUNT}, 0) as amount"),
        F.expr("1L as copies"),
    )
    return _framed_volumes(rows, keys, days)


def _framed_volumes(rows: DataFrame, keys: Sequence[str], days: Sequence[int]) -> DataFrame:
    """Volumes of rows that have ``TIME_US`` and stand for ``copies`` payments of ``amount`` in all."""

    def over(by: str, frame: str) -> str:
        return f"over (partition by {by} order by {TIME_US} range between {frame})"

    def running(by: str):
        def total_at(d: int) -> str:
            upto = f"{d * DAY_US}L preceding" if d else "current row"
            return f"sum(amount) {over(by, f'unbounded preceding and {upto}')}"

        return total_at

    linked = f"{USER}, {RECIPIENT}"
    peers = "current row and current row"
    return rows.selectExpr(
        USER, RECIPIENT, TIME, *keys, f"{_total('amount')} as amount", "copies",
        f"sum(copies) {over(USER, peers)} as user_ties",
        f"sum(copies) {over(linked, peers)} as recipient_ties",
        *_totals(running(USER), days, "lifetime", "any"),
        *_totals(running(linked), days, "linked_lifetime", "linked"),
    )


def _asked_totals(
    points: DataFrame, keys: Sequence[str], days: Sequence[int], tasks: int | None
) -> DataFrame:
    """Running totals ``upto_d`` of ``amount`` at every point, ``d`` days back.

    ``points`` has one row per (keys, time). Each point puts its amount at its own time
    and asks for the total at that time and ``d`` days earlier, wherever that piece is.
    """
    offsets = (0, *days)
    asked = points.selectExpr(
        *keys, TIME_US, "amount", f"explode(array({', '.join(map(str, offsets))})) as days"
    ).selectExpr(
        *keys, TIME_US, "days",
        f"{TIME_US} - days * {DAY_US}L as at",
        "if(days = 0, amount, 0) as amount",
    )
    totals = running_totals(asked, keys, ["at"], "amount", VOLUME_TYPE, tasks=tasks)
    return (
        dealt(totals, tasks, *keys, TIME_US)
        .groupBy(*keys, TIME_US)
        .agg(*(F.expr(f"max(if(days = {d}, total, null)) as upto_{d}") for d in offsets))
    )


def _pieces(payments: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """One row per distinct payment shape, cut at quantiles of (customer, time) and stored."""
    shapes = (
        payments.groupBy(USER, RECIPIENT, TIME, *keys)
        .agg(F.expr(f"{_total(f'sum(coalesce({AMOUNT}, 0))')} as amount"), F.expr("count(*) as copies"))
        .withColumn(TIME_US, micros(TIME))
    )
    cut = shapes.repartitionByRange(*(() if tasks is None else (tasks,)), USER, TIME_US)
    return stored(cut.withColumn(PIECE, F.spark_partition_id()))


def _spanning(pieces: DataFrame, policy: SkewPolicy) -> HotKeys:
    """The customers with rows in several pieces, or in one that ties have made too large for a task.

    No more than there are cuts, as each divides one customer, and tasks that the others would fill.
    """
    of = pieces.groupBy(USER).agg(F.expr(f"min({PIECE}) < max({PIECE}) as divided"), F.expr("count(*) as rows"))
    found = of.where(F.col("divided") | (F.col("rows") > policy.task_rows)).collect()
    return HotKeys.of(pieces, USER, [row[USER] for row in found], policy, sum(row["rows"] for row in found))


def _spanning_volumes(
    shapes: DataFrame, days: Sequence[int], asked: Collection[str], policy: SkewPolicy, count: int
) -> DataFrame:
    """One row per distinct payment shape, of which there are ``count``, with the columns ``asked`` for.

    Totals are stored on the way, where the planner can't leave out those that nobody reads.
    """

    def volumes(by: Sequence[str], lifetime: str, window: str, ties: str) -> DataFrame | None:
        read = [d for d in days if f"{window}_{d}" in asked]
        if not (read or {lifetime, ties} & set(asked)):
            return None
        # Each shape asks for its own total and for one per window.
        tasks = parts(count * (1 + len(read)), policy)
        at = (
            dealt(shapes.dropna(subset=list(by)), tasks, *by, TIME_US)
            .groupBy(*by, TIME_US)
            .agg(F.expr(f"{_total('sum(amount)')} as amount"), F.expr(f"sum(copies) as {ties}"))
        )
        totals = _asked_totals(at, by, read, tasks)
        return totals.join(at.drop("amount"), [*by, TIME_US]).selectExpr(
            *by, TIME_US, ties, *_totals(lambda d: f"upto_{d}", read, lifetime, window)
        )

    any_recipient = volumes([USER], "lifetime", "any", "user_ties")
    linked = volumes([USER, RECIPIENT], "linked_lifetime", "linked", "recipient_ties")
    if any_recipient is not None:
        shapes = shapes.join(any_recipient, [USER, TIME_US])
    if linked is not None:
        shapes = shapes.join(linked, [USER, RECIPIENT, TIME_US], "left")
    return shapes.drop(TIME_US)


def _hot_volumes(
    payments: DataFrame, keys: Sequence[str], days: Sequence[int], asked: Collection[str],
    tasks: int | None, policy: SkewPolicy,
) -> list[DataFrame]:
    """Volumes of hot customers: of those inside one piece, and of those that go on over several.

    A payment without a time counts in the totals, ahead of all others, and has no row of its own.
    """
    pieces = _pieces(payments, keys, tasks)
    spanning = _spanning(pieces, policy)
    within, beyond = spanning.split(pieces, USER) if spanning else (pieces, None)
    found = [_framed_volumes(dealt(within.drop(PIECE), tasks, USER), keys, days)]
    if beyond is not None:
        volumes = _spanning_volumes(stored(beyond.drop(PIECE)), days, asked, policy, spanning.rows)
        # What follows is keyed by customer and time; such a customer alone is too much for a task.
        found.append(dealt(volumes, parts(spanning.rows, policy), USER, TIME))
    return [volumes.dropna(subset=[TIME]) for volumes in found]


def _volume_tables(
    payments: DataFrame,
    keys: Sequence[str],
    days: Sequence[int],
    hot: HotKeys | Sequence | None,
    policy: SkewPolicy,
    asked: Collection[str] | None = None,
) -> list[DataFrame]:
    """``base_volumes`` in tables without a customer in common, each dealt by customer where it may be.

    ``asked`` lists the measures the caller reads; None means all.
    """
    any_recipient = ["lifetime", *(f"any_{d}" for d in days)]
    linked = ["linked_lifetime", *(f"linked_{d}" for d in days)]
    counts = ["amount", "copies", "user_ties", "recipient_ties"]
    asked = [c for c in (*counts, *any_recipient, *linked) if asked is None or c in asked]
    if hot is None:
        hot = hot_keys(payments, USER, policy=policy)[USER]
    elif not isinstance(hot, HotKeys):
        hot = HotKeys.of(payments, USER, hot, policy)
    tasks = parts(hot.rows, policy)
    cold_rows, hot_rows = hot.split(payments, USER) if hot else (payments, None)
    tables = [_plain_volumes(dealt(cold_rows, tasks, USER), keys, days)]
    if hot_rows is not None:
        tables += _hot_volumes(hot_rows, keys, days, asked, tasks, policy)
    measures = [f"if({RECIPIENT} is null, {_total('0')}, {c}) as {c}" if c in linked else c for c in asked]
    return [volumes.selectExpr(USER, RECIPIENT, TIME, *keys, *measures) for volumes in tables]


def _of_each(tables: list[DataFrame], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step``, which is keyed by customer, over each table: no exchange of their union."""
    return reduce(DataFrame.unionByName, map(step, tables))


def base_volumes(
    payments: DataFrame,
    keys: Sequence[str],
    days: Sequence[int] = (),
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Volumes at the time of every payment, before any tie rule is applied.

    ``copies`` is how many payments a row stands for, ``amount`` what they add up to, ``user_ties`` and
    ``recipient_ties`` how many payments share its (customer, time) and (customer,
    recipient, time). Same-recipient volumes are 0 where the recipient is unknown: a
    NULL recipient is never the same as another. ``hot`` lists the hot customers; None
    looks for them in ``payments``. ``payments`` is read twice for that search and twice more
    with hot customers, so it should be a stored table; their collapsed payments are written here. Payments
    whose number is known from that search are dealt to tasks of ``policy.task_rows`` each.
    """
    return _of_each(_volume_tables(payments, keys, days, hot, policy), lambda volumes: volumes)


def _faithful(ties: str) -> bool:
    if ties not in ("faithful", "once"):
        raise ValueError(f"ties must be 'faithful' or 'once', not {ties!r}")
    return ties == "faithful"


def rolling_volumes_grouped(
    payments: DataFrame,
    windows: Sequence[int] = LimitConfig().windows,
    ties: str = "faithful",
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Lifetime and same-recipient trailing volumes per payment group.

    A group is one (time, customer, recipient, currency, risk level). With
    ``ties="faithful"`` a group of k payments counts its volumes k times, with
    ``ties="once"`` one time.
    """
    multiply = _faithful(ties)
    names = {"lifetime": "lifetime_volume", **{f"linked_{d}": window_column(d) for d in windows}}

    def grouped(base: DataFrame) -> DataFrame:
        return base.groupBy(
            F.col(TIME).alias("refdate"), USER, F.col(RECIPIENT).alias("recipient_id"), *ENTITLEMENT_KEYS
        ).agg(F.expr("sum(copies) as copies"), *(F.expr(f"max({c}) as {c}") for c in names))

    tables = _volume_tables(payments, ENTITLEMENT_KEYS, windows, hot, policy, ["copies", *names])
    return _of_each(tables, grouped).select(
        "refdate", USER, "recipient_id", *ENTITLEMENT_KEYS,
        *(
            (times(column, "copies") if multiply else F.col(column)).alias(name)
            for column, name in names.items()
        ),
    )


def _windowed(
    payments: DataFrame,
    columns: dict[str, tuple[str, str]],
    windows: Sequence[int],
    ties: str,
    hot: HotKeys | Sequence | None,
    policy: SkewPolicy,
    per_recipient: bool = True,
    distinct: bool = True,
) -> DataFrame:
    """(Payment shape, volumes); ``columns`` maps name -> (volume, ties).

    Without ``distinct`` tied payments keep a row each, which is all the same to a
    first date.
    """
    multiply = _faithful(ties)
    recipient = [F.col(RECIPIENT).alias("recipient_id")] if per_recipient else []

    def shapes(base: DataFrame) -> DataFrame:
        found = base.select(
            F.col(TIME).alias("refdate"), USER, *recipient, *MONITORING_KEYS,
            *(
                # An unknown recipient has volume 0 and, on the hot way, no tie count.
                (times(volume, f"coalesce({count}, 1)") if multiply else F.col(volume)).alias(name)
                for name, (volume, count) in columns.items()
            ),
        )
        return found.distinct() if distinct else found

    asked = {c for pair in columns.values() for c in pair}
    return _of_each(_volume_tables(payments, MONITORING_KEYS, windows, hot, policy, asked), shapes)


LIFETIME_COLUMNS = {
    "lifetime_volume": ("lifetime", "user_ties"),
    "same_recipient_volume": ("linked_lifetime", "recipient_ties"),
}


def _trailing(kind: str, ties: str, windows: Sequence[int], prefix: str = "") -> dict:
    return {f"{prefix}{window_column(d)}": (f"{kind}_{d}", ties) for d in windows}


def linked_volumes(
    payments: DataFrame,
    ties: str = "faithful",
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
    distinct: bool = True,
) -> DataFrame:
    """Lifetime volume and lifetime volume to the same recipient, per payment shape.

    With ``ties="faithful"`` the volumes are multiplied by the number of payments that
    share the (customer, time) or (customer, recipient, time).
    """
    return _windowed(payments, LIFETIME_COLUMNS, (), ties, hot, policy, distinct=distinct)


def linked_window_volumes(
    payments: DataFrame,
    windows: Sequence[int] = LimitConfig().windows,
    ties: str = "faithful",
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
    distinct: bool = True,
) -> DataFrame:
    """Trailing volumes to the same recipient, per payment shape."""
    columns = _trailing("linked", "recipient_ties", windows)
    return _windowed(payments, columns, windows, ties, hot, policy, distinct=distinct)


def user_window_volumes(
    payments: DataFrame,
    windows: Sequence[int] = LimitConfig().windows,
    ties: str = "faithful",
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
    distinct: bool = True,
) -> DataFrame:
    """Trailing volumes to any recipient, per payment shape without the recipient."""
    columns = _trailing("any", "user_ties", windows)
    return _windowed(
        payments, columns, windows, ties, hot, policy, per_recipient=False, distinct=distinct
    )


def monitoring_volumes(
    payments: DataFrame,
    windows: Sequence[int] = LimitConfig().windows,
    ties: str = "faithful",
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
    distinct: bool = True,
) -> DataFrame:
    """All volumes of the four monitored rules at once: same-recipient windows as
    ``linked_last_*``, any-recipient windows as ``any_last_*``."""
    columns = {
        **LIFETIME_COLUMNS,
        **_trailing("linked", "recipient_ties", windows, "linked_"),
        **_trailing("any", "user_ties", windows, "any_"),
    }
    return _windowed(payments, columns, windows, ties, hot, policy, distinct=distinct)


def volume_by_risk(volumes: DataFrame, config: LimitConfig = LimitConfig()) -> DataFrame:
    """Keep the trailing window of the row's risk level as ``volume_at_day``."""
    kept = [c for c in volumes.columns if not c.endswith("_volume")]
    return volumes.select(*kept, risk_volume(config).alias("volume_at_day"))


def volume_check(
    payments: DataFrame, hot: HotKeys | Sequence | None = None, policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Per customer the sum of all payments and the lifetime volume at the last one.

    The control total comes from the same rows as the volumes, without another exchange;
    with every payment counted once the two are equal.
    """

    def checked(base: DataFrame) -> DataFrame:
        return base.groupBy(USER).agg(
            F.expr(f"{_total('sum(amount)')} as total_volume"),
            F.max_by("lifetime", TIME).alias("last_volume"),
        )

    return _of_each(_volume_tables(payments, (), (), hot, policy, ["amount", "lifetime"]), checked)
