"""Lookups that read one row group, and merges that write the touched files only."""

import pytest
from pyspark.sql import functions as F

from territory.operators import lookup, merge
from territory.storage import children


def test_one_key_reads_one_row_group(spark, tmp_path):
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("email"), (F.col("id") % 7).alias("n"))
    table = lookup.write_sorted(rows, str(tmp_path / "t"), "id", ["email"], files=4, row_group_bytes=1 << 20)
    one = lookup.by_key(table, "id", "k0123456")
    assert [r.n for r in one.collect()] == [123456 % 7] and lookup.rows_scanned(one) < 25_000
    email = rows.where("id = 'k0000042'").first().email
    other = lookup.by_key(table, "email", email)  # not sorted by it: bloom filters
    assert [r.id for r in other.collect()] == ["k0000042"] and lookup.rows_scanned(other) < 25_000
    assert lookup.by_key(table, "id", "nobody").collect() == lookup.by_key(table, "id", None).collect() == []
    few = lookup.by_keys(table, spark.createDataFrame([("k0000001",), ("k0199999",), ("k0000001",), (None,), ("x",)], "a string"))
    assert sorted(r.id for r in few.collect()) == ["k0000001", "k0199999"] and lookup.rows_scanned(few) < 100_000
    many = lookup.by_keys(table, rows.where("id < 'k0000300'").select("id"))
    assert many.count() == 300
    assert lookup.by_keys(table, rows.limit(0).select("id")).collect() == []


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(20_000).select("id", (F.col("id") % 50).alias("parent"), F.lit("old").alias("name"), F.lit(True).alias("is_active"))
    rows.repartitionByRange(100, "id").write.parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def files(spark, path):
    return {x for x in children(spark, path) if x.startswith("part-")}


def test_only_touched_files_are_written(spark, table):
    before, target = files(spark, table), spark.read.parquet(table)
    changed = spark.createDataFrame([(i * 1999, 1, "new", True) for i in range(9)] + [(50_000, 2, "added", True)], target.schema)
    want = merge.upsert(target, changed, ["id"], ["name", "parent"]).collect()
    assert merge.rewrite(spark, table, changed, ["id"], lambda rows, source: merge.upsert(rows, source, ["id"], ["name", "parent"])) <= 9
    after = files(spark, table)
    assert len(before - after) <= 9 and sorted(spark.read.parquet(table).collect()) == sorted(want)
    assert merge.rewrite(spark, table, changed.where("id = 0"), ["id"], lambda rows, source: merge.soft_delete(rows, source, ["id"])) == 1
    assert spark.read.parquet(table).where("not is_active").count() == 1
    nobody = changed.where("false")
    assert merge.rewrite(spark, table, nobody, ["id"], lambda rows, source: merge.upsert(rows, source, ["id"], ["name"])) == 0 and spark.read.parquet(table).count() == len(want)


def test_a_killed_rewrite_is_finished(spark, table, monkeypatch):
    changed = spark.createDataFrame([(5, 1, "new", True)], spark.read.parquet(table).schema)
    upsert = lambda rows, source: merge.upsert(rows, source, ["id"], ["name"])
    real, calls = merge.delete, []

    def killed(session, path):
        calls.append(path)
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(merge, "delete", killed)  # the new file is in, the old one isn't out yet
        merge.rewrite(spark, table, changed, ["id"], upsert)
    assert calls and spark.read.parquet(table).count() > 20_000
    merge.finish(spark, table)
    merge.finish(spark, table)
    assert spark.read.parquet(table).count() == 20_000 and spark.read.parquet(table).where("name = 'new'").count() == 1
    assert not [x for x in children(spark, table) if x.startswith(("_plan", "_staged"))] and merge.delete is real
