"""Rows by key: tables sorted by their key, with bloom filters on it and on other columns that rows are asked for by.

A lookup is a filter that goes down to the scan. Of a sorted table one row group's statistics hold the key; bloom filters rule out
row groups for columns that the table isn't sorted by.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are sent to the scan as a list; of more, their least and largest go there, and a join does the rest.
LISTED = 10
#: Distinct values that the bloom filter of a row group is made for.
BLOOM_ROWS = 1_000_000


def write_sorted(df: DataFrame, path: str, key: str, also: Iterable[str] = (), files: int | None = None, row_group_bytes: int = 32 << 20) -> DataFrame:
    """Write a table by ranges of its key, sorted, with bloom filters on the key and the columns in `also`. Null keys come first."""
    rows = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    out = rows.sortWithinPartitions(key).write.option("parquet.block.size", row_group_bytes)
    for column in (key, *also):
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_ROWS))
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    """The rows whose key, or any other column, has a value; none for null."""
    return table.where(F.col(key) == F.lit(value))


def by_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among those of a frame (its first column); each once, null and unknown keys find nothing.

    A few keys are a list in the scan's filter. More are a semi-join, and the range that they span is the scan's filter.
    """
    name = keys.columns[0]
    distinct = keys.select(F.col(name).alias(key)).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in distinct.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return table.where(F.col(key).isin(few)) if few else table.limit(0)
    low, high = distinct.agg(F.min(key), F.max(key)).first()
    return table.where(F.col(key).between(F.lit(low), F.lit(high))).join(distinct, key, "left_semi").select(*table.columns)


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of a frame's plan gave when it was last run with collect(); row groups that were ruled out give none."""
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return total
