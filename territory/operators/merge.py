"""Writes as new tables: upserts, insert-or-ignore, soft deletes and replacements by joins.

No table format is assumed. Each function gives the target's new state, to be written to another path and swapped in;
none changes what it reads. `rewrite` applies one of them in place to those files of a large table that hold the keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from territory.storage import children, delete, filesystem, read_text, write_text


def _one_each(source: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: of several the least by its other columns, in their order."""
    rest = [c for c in source.columns if c not in keys]
    if not rest:
        return source.select(*keys).distinct()
    return source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in source.columns])


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], live: Column | None = None) -> DataFrame:
    """Rows of the source, one for each key, whose key the target (where `live`) doesn't have; append these."""
    taken = (target if live is None else target.where(live)).select(*keys)
    return _one_each(source, keys).join(taken, keys, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """The target with the source's `update` columns where the key is in both, and the source's other rows added."""
    new = _one_each(source, keys).withColumn("__new", F.lit(True))
    new = new.withColumnsRenamed({c: f"__{c}" for c in source.columns if c not in keys})
    both = target.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in source.columns:
            out.append(F.col(c))
        else:
            added = F.col("__old").isNull()
            out.append(F.when(added | (F.col("__new").isNotNull() & F.lit(c in update)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def patch(target: DataFrame, changes: DataFrame, keys: list[str], clears: tuple[str, ...] = ()) -> DataFrame:
    """The target with changed columns; a null change leaves the value, but for columns in `clears`."""
    fields = [c for c in changes.columns if c not in keys]
    new = changes.withColumnsRenamed({c: f"__{c}" for c in fields}).withColumn("__hit", F.lit(True))
    rows = target.join(new, keys, "left")
    value = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if c in clears else F.coalesce(f"__{c}", c) for c in fields}
    return rows.select(*[value[c].alias(c) if c in value else F.col(c) for c in target.columns])


def soft_delete(target: DataFrame, gone: DataFrame, keys: list[str], clear: tuple[str, ...] = ()) -> DataFrame:
    """The target with is_active false for the given keys; array columns in `clear` become empty with it."""
    rows = target.join(gone.select(*keys).distinct().withColumn("__gone", F.lit(True)), keys, "left")
    hit = F.coalesce("__gone", F.lit(False))
    values = {"is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active"))} | {c: F.when(hit, F.array().cast(target.schema[c].dataType)).otherwise(F.col(c)) for c in clear}
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in target.columns])


def replace_children(links: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Links with all those of the new links' parents replaced."""
    return links.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def union_aliases(stores: DataFrame, more: DataFrame, id: str = "id", column: str = "alternate_names") -> DataFrame:
    """Stores with more alternate names, sorted; `more` has (id, name), any number for each."""
    added = more.groupBy(F.col(id)).agg(F.collect_set("name").alias("__more"))
    merged = F.array_sort(F.array_union(F.coalesce(column, F.array().cast("array<string>")), F.col("__more")))
    return stores.join(added, id, "left").withColumn(column, F.when(F.col("__more").isNull(), F.col(column)).otherwise(merged)).drop("__more")


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row of each key: the first by the given order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__first", first).where("__first = 1").drop("__first")


def apply_allocations(target: DataFrame, add: DataFrame, remove: DataFrame, keys: list[str]) -> DataFrame:
    """Allocations after adding (or reactivating) and then removing."""
    return soft_delete(upsert(target, add, keys, ["is_active", "allocated_by"]), remove, keys)


def rewrite(spark: SparkSession, path: str, source: DataFrame, keys: list[str], change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Apply change(rows, source) to a Parquet table in place, by files: only those that hold a key of the source are read and written anew.

    `change` is one of the functions above, which gives the new state of the rows it gets: these have all rows of any of the source's
    keys. Gives the number of files replaced. The new files are staged, and a plan of what to add and what to remove is written down before
    anything changes: if the driver dies after that, `finish` ends it, and readers should call it first. The table has no partition folders.
    """
    finish(spark, path)
    target = spark.read.parquet(path)
    held = target.select(*keys, F.col("_metadata.file_path").alias("__file")).join(source.select(*keys).distinct(), keys, "left_semi")
    old = sorted(r[0] for r in held.select("__file").distinct().collect())  # names of files
    rows = spark.read.schema(target.schema).parquet(*old) if old else target.limit(0)
    id = uuid.uuid4().hex
    change(rows, source).select(*target.columns).write.parquet(f"{path}/_staged-{id}")
    new = [x for x in children(spark, f"{path}/_staged-{id}") if x.startswith("part-")]
    write_text(spark, f"{path}/_plan-{id}.json", json.dumps({"id": id, "add": new, "remove": [x.rsplit("/", 1)[-1] for x in old]}))
    finish(spark, path)
    return len(old)


def finish(spark: SparkSession, path: str) -> None:
    """Carry out the plans that a driver left; each step may have been done already. Staged files without a plan are dropped."""
    names = children(spark, path)
    for plan in (x for x in names if x.startswith("_plan-")):
        todo = json.loads(read_text(spark, f"{path}/{plan}"))
        for name in todo["add"]:
            fs, staged = filesystem(spark, f"{path}/_staged-{todo['id']}/{name}")
            if fs.exists(staged):
                fs.rename(staged, filesystem(spark, f"{path}/{name}")[1])
        for name in todo["remove"]:
            delete(spark, f"{path}/{name}")
        delete(spark, f"{path}/{plan}")
    for left in (x for x in names if x.startswith("_staged-")):
        delete(spark, f"{path}/{left}")
