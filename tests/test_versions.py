"""Versioned tables, clones, and rule months that are refreshed in place."""

import pytest
from brute import spark_rows
from pyspark.sql import functions as F

from limitline.plans.backtest import Backtest
from limitline.plans.stored import refresh_months, store_months
from limitline.operators import limits, volumes
from limitline.sources.star_schema import from_star_schema
from limitline.sources.versions import TableExists, VersionedTable


def numbers(df):
    return sorted(r.id for r in df.collect())


def test_versions_replace_create_and_drop(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    assert numbers(table.create(spark.range(3))) == [0, 1, 2]
    with pytest.raises(TableExists):
        table.create(spark.range(9))
    assert numbers(table.replace(spark.range(5, 7))) == [5, 6]
    assert table.versions() == [1, 2] and numbers(table.read(1)) == [0, 1, 2]
    assert numbers(table.replace(table.read().limit(0))) == []
    # A table may be replaced by what is read from it.
    assert numbers(table.replace(table.read(2).union(table.read(1)))) == [0, 1, 2, 5, 6]
    table.drop()
    assert not table.exists()


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.create(spark.range(3))
    broken = spark.range(10).withColumn("id", F.expr("if(id = 7, raise_error('lost'), id)").cast("long"))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert table.versions() == [1] and numbers(table.read()) == [0, 1, 2]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.create(spark.range(1))
    monkeypatch.setattr(two, "_next", lambda: 2)
    one.replace(spark.range(2))
    with pytest.raises(TableExists):
        two.replace(spark.range(5))
    assert numbers(one.read()) == [0, 1]


def test_a_clone_shares_files_and_goes_its_own_way(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.create(spark.range(4))
    copy = table.clone(str(tmp_path / "copy"))
    assert set(copy.read().inputFiles()) == set(table.read().inputFiles())
    with pytest.raises(TableExists):
        table.clone(str(tmp_path / "copy"))
    table.replace(spark.range(9, 10))
    assert numbers(copy.read()) == [0, 1, 2, 3] and numbers(table.read()) == [9]
    copy.replace(spark.range(1))
    table.drop()
    assert numbers(copy.read()) == [0] and numbers(copy.read(1)) == [0, 1, 2, 3]


def test_parts_are_replaced_alone(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.range(12).selectExpr("id", "if(id % 4 = 3, null, concat('p/', id % 4)) as part")
    table.create(rows, by="part")
    before = {f["part"]: f["path"] for f in table.manifest()["folders"]}
    assert len(before) == 4
    none = [r for r in before if r.startswith("__HIVE")][0]
    new = spark.createDataFrame([(100, None)], "id long, part string")
    table.replace_parts(new, [None])
    after = {f["part"]: f["path"] for f in table.manifest()["folders"]}
    assert {k for k in before if before[k] != after.get(k)} == {none}
    assert numbers(table.read()) == sorted([i for i in range(12) if i % 4 != 3] + [100])
    assert numbers(table.read(parts=[None])) == [100] and numbers(table.read(1, parts=[None])) == [3, 7, 11]
    with pytest.raises(ValueError):
        table.replace_parts(rows, [None])


@pytest.mark.parametrize("since", ["2019-01-01", "2021-06-01", "2021-12-20"])
def test_refreshed_months_equal_a_full_build(spark, sf_dir, tmp_path, since):
    plan = Backtest(from_star_schema(spark, sf_dir))
    plan.store_payments(str(tmp_path / "payments"))

    def months(payments):
        grouped = volumes.rolling_volumes_grouped(payments, hot=[])
        return limits.month_hit(limits.limit_date(grouped, "lifetime_volume"))

    table = VersionedTable(spark, str(tmp_path / "months"))
    store_months(table, months(plan.payments.where(f"action_creation_time < '{since}'")))
    before = {f["part"]: f["path"] for f in table.manifest()["folders"]}
    late = plan.payments.where(f"action_creation_time >= '{since}'").select("user_profile_id")
    touched = refresh_months(table, months(plan.payments), late)
    assert spark_rows(table.read()) == spark_rows(months(plan.payments))
    after = {f["part"]: f["path"] for f in table.manifest()["folders"]}
    assert all(before[p] == after[p] for p in before if p not in set(map(str, touched)))
    if since == "2021-12-20":
        assert len(touched) < len(before)
    # Nothing to do the second time.
    assert refresh_months(table, months(plan.payments), late) == []
    assert table.versions() == ([1, 2] if touched else [1])
