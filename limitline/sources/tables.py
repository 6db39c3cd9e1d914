"""Access to the source tables and the ways to store a result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limitline.sources.schemas import DAY, SCHEMAS, conform


class Sources:
    """The fourteen source tables as attributes, read on first use and type-checked."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, table: str) -> DataFrame:
        if table not in SCHEMAS:
            raise AttributeError(table)
        if table not in self._tables:
            self._tables[table] = conform(self._load(table), table)
        return self._tables[table]

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Sources:
        """One parquet folder or file ``<root>/<table>.parquet`` per table."""
        return cls(lambda table: spark.read.parquet(f"{root}/{table}.parquet"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str] | None = None) -> Sources:
        """Catalog tables, by default under the table's own name."""
        return cls(lambda table: spark.table((names or {}).get(table, table)))

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Sources:
        return cls(frames.__getitem__)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Create or replace a stored table and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Store a full copy of a table; fails if one is already there."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def store_by_day(payments: DataFrame, path: str, time: str = "action_creation_time") -> None:
    """Store payments in a folder per day, so that a join on the day prunes what is read."""
    by_day = payments.withColumn(DAY, F.to_date(time))
    # A day may be large: Spark deals each out over as many tasks as its size asks for.
    by_day.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(path)


def bucketed_table(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], buckets: int, path: str) -> DataFrame:
    """Store a catalog table in buckets by key, sorted, so that reading it by key needs no exchange."""
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
