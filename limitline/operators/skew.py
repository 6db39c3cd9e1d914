"""Hot-key detection, salted joins, checked broadcasts and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitline.config import SkewPolicy

SALT = "_salt"
_HOT = "_hot_key"


class HotKeys:
    """The hot values of a column as a table with one column, ``key``.

    Their number is known, so the table is marked for broadcast only where it is small.
    ``rows`` is how many rows have any value in the column, None where nobody counted them.
    """

    def __init__(
        self, table: DataFrame | None, count: int, policy: SkewPolicy = SkewPolicy(), rows: int | None = None
    ):
        self.table, self.count, self.policy, self.rows = table, count, policy, rows

    @classmethod
    def of(
        cls, df: DataFrame, column: str, values: Sequence, policy: SkewPolicy = SkewPolicy(), rows: int | None = None
    ) -> HotKeys:
        """Given values, as a table with the type of ``df``'s column."""
        if not values:
            return cls(None, 0, policy, rows)
        kind = df.schema[column].dataType.simpleString()
        return cls(df.sparkSession.createDataFrame([(v,) for v in values], f"key {kind}"), len(values), policy, rows)

    def uncounted(self) -> HotKeys:
        """The same keys, for rows that are stored as they shall be dealt."""
        return HotKeys(self.table, self.count, self.policy)

    def __bool__(self) -> bool:
        return self.count > 0

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator:
        return iter(row.key for row in self.table.collect()) if self else iter(())

    def _side(self, name: str = "key") -> DataFrame:
        side = self.table.select(F.col("key").alias(name))
        return F.broadcast(side) if self.count <= self.policy.broadcast_rows else side

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows of the other keys (NULL included) and those of the hot ones."""
        side = self._side(column)
        return df.join(side, column, "left_anti"), df.join(side, column, "left_semi")

    def flagged(self, df: DataFrame, column: str) -> tuple[DataFrame, Column]:
        """``df`` with a column that tells whether the key is hot, and that condition."""
        side = self._side(_HOT)
        return df.join(side, F.col(column) == F.col(_HOT), "left"), F.col(_HOT).isNotNull()


def _place(key: str, number: int, places: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(places)) + F.lit(number * places)


def hot_keys(df: DataFrame, *keys: str, policy: SkewPolicy = SkewPolicy()) -> dict[str, HotKeys]:
    """The values of each key column that hold more than ``policy.hot_rows`` rows, exactly.

    Two passes. The first counts rows per hash place, for all columns at once: a fixed
    number of counters, summed map-side, whatever the number of keys. A hot key makes its
    place heavy, so the second pass counts only keys of heavy places; without any there is
    none. There may be any number of hot keys: few stay in the plan, more are stored, and
    where the places allow for more the exact counts are made once and stored at once.
    """
    places = policy.key_places
    at = F.array(*(F.when(F.col(k).isNotNull(), _place(k, i, places)) for i, k in enumerate(keys)))
    counted = df.select(F.explode(at).alias("at")).where("at is not null").groupBy("at").count()
    heavy = F.collect_list(F.when(F.col("count") > policy.hot_rows, F.col("at")))
    most = F.expr(f"sum(count div {policy.hot_rows + 1})")
    of_keys = counted.groupBy(F.expr(f"at div {places}").alias("number")).agg(
        F.sum("count").alias("rows"), heavy.alias("heavy"), most.alias("most")
    )
    found = {row["number"]: (row["heavy"], row["rows"], row["most"]) for row in of_keys.collect()}
    return {key: _hot(df, key, i, *found.get(i, ([], 0, 0)), policy) for i, key in enumerate(keys)}


def _hot(
    df: DataFrame, key: str, number: int, heavy: list[int], rows_: int, most: int, policy: SkewPolicy
) -> HotKeys:
    """The hot values of one column, of which ``most`` is the largest number there can be."""
    if not heavy:
        return HotKeys(None, 0, policy, rows_)
    side = df.sparkSession.createDataFrame([(p,) for p in heavy], "at long")
    rows = df.select(F.col(key).alias("key")).where("key is not null").withColumn("at", _place("key", number, places=policy.key_places))
    found = rows.join(F.broadcast(side), "at", "left_semi").groupBy("key").count()
    found = found.where(F.col("count") > policy.hot_rows).select("key")
    if most > policy.max_hot_keys:
        found = materialise(found)
    first = [row.key for row in found.limit(policy.max_hot_keys + 1).collect()]
    if len(first) <= policy.max_hot_keys:
        return HotKeys.of(found, "key", first, policy, rows_)
    return HotKeys(found, found.count(), policy, rows_)


def parts(rows: int | None, policy: SkewPolicy = SkewPolicy()) -> int | None:
    """Into how many tasks so many rows are dealt; None leaves that to Spark."""
    number = -(-(rows or 0) // policy.task_rows)
    return number if number > 1 else None


def dealt(df: DataFrame, number: int | None, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` to ``number`` tasks, for the steps keyed by these or more columns.

    Adaptive execution merges the partitions of its own exchanges up to a size in compressed
    bytes, which repetitive rows outgrow many times once they are sorted in memory.
    """
    return df if number is None else df.repartition(number, *columns)


def skew_join(
    facts: DataFrame,
    on: str,
    sides: Sequence[tuple[DataFrame, str]],
    hot: HotKeys | Sequence = (),
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Equi-join of ``facts`` with per-key ``sides``, hot keys spread over salts.

    ``sides`` lists (table, how), how being inner, left, left_semi or left_anti. Without
    hot keys these are plain joins: Spark broadcasts a side only when its own size check
    allows it, and otherwise shuffles ``facts`` once for all sides. The rows of a hot key
    get one of ``policy.salts`` salts and its rows in the sides are repeated once per
    salt; every other row keeps salt 0.
    """
    if not isinstance(hot, HotKeys):
        hot = HotKeys.of(facts, on, hot, policy)
    if not hot:
        for side, how in sides:
            facts = facts.join(side, on, how)
        return facts
    # The partition id spreads exact copies of one row, which hash alike.
    spread = F.pmod(F.xxhash64(*facts.columns) + F.spark_partition_id(), F.lit(policy.salts))
    joined, is_hot = hot.flagged(facts, on)
    joined = joined.withColumn(SALT, F.when(is_hot, spread.cast("int")).otherwise(0)).drop(_HOT)
    for side, how in sides:
        repeated, is_hot = hot.flagged(side, on)
        salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(policy.salts - 1))).otherwise(F.array(F.lit(0)))
        joined = joined.join(repeated.withColumn(SALT, F.explode(salts)).drop(_HOT), [on, SALT], how)
    return joined.drop(SALT)


def broadcast_if_small(df: DataFrame, rows: int, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Mark ``df``, which has no more than ``rows`` rows, for broadcast only if these are few.

    Otherwise the join shuffles and adaptive execution splits its skewed partitions.
    """
    return F.broadcast(df) if rows <= policy.broadcast_rows else df


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; only local test sessions choose their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="limitline-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder: readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/limitline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
