"""Running totals per key, also for keys with more rows than one task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.operators.skew import dealt, materialise

PIECE = "_piece"


def running_totals(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, kind: str, name: str = "total",
    tasks: int | None = None,
) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows of the key up to this one's ``order``.

    Rows of equal order count for each other. A distributed prefix sum: Spark cuts the
    rows into pieces at quantiles of (key, order), so that no piece outgrows a task, however
    the rows are spread over keys and time. Totals run inside (key, piece); the totals of a
    key's earlier pieces are added, of which there is one row per key and piece. The pieces
    are stored before they are used twice: another sample could cut them elsewhere. ``tasks``
    is the number of pieces, and of the tasks that take them up; None leaves it to Spark.
    """
    def total(expression: str) -> str:
        return f"cast({expression} as {kind})"

    keys = ", ".join(by)
    cut = rows.repartitionByRange(*(() if tasks is None else (tasks,)), *by, *order)
    cut = dealt(materialise(cut.withColumn(PIECE, F.spark_partition_id())), tasks, *by, PIECE)
    earlier = f"over (partition by {keys} order by {PIECE} rows between unbounded preceding and 1 preceding)"
    carried = (
        cut.groupBy(*by, PIECE)
        .agg(F.expr(f"{total(f'sum({value})')} as piece_total"))
        .selectExpr(*by, PIECE, f"{total(f'coalesce(sum(piece_total) {earlier}, 0)')} as carry")
    )
    upto = (
        f"over (partition by {keys}, {PIECE} order by {', '.join(order)} "
        "range between unbounded preceding and current row)"
    )
    inside = cut.selectExpr("*", f"{total(f'sum({value}) {upto}')} as inside")
    return (
        inside.join(carried, [*by, PIECE])
        .withColumn(name, F.expr(total("carry + inside")))
        .drop(PIECE, "carry", "inside")
    )
