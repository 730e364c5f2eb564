"""What the operators on integer vectors share: blocks of vectors, exact distances, seeds, means and totals.

Vectors are packed once into blocks, rows of a written table that hold some thousand vectors and what an operator
keeps on them between rounds. A round reads one table of blocks and writes the next: a lost executor costs its tasks only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from territory.llm.base import give_back

#: Vectors in a block.
BLOCK = 1 << 14
#: Up to so many rows of totals are broadcast (some tens of MB); more are joined by key and salt.
TOTALS, SALTS = 200_000, 64
#: Relative margin of bounds, far above rounding errors: it only costs distances.
MARGIN = 1e-12


def packed(df: DataFrame, id: str, vector: str, scale: float, label: str | None = None, width: int | None = None) -> DataFrame:
    """(ids, labels, width, top, x): blocks of vectors floor(scale * component), as 32-bit integers, padded with zeros to the block's longest.

    Rows whose vector is null or holds null or non-finite components are left out; with `width`, those of another
    length too. A component of 2^31 or more after scaling is an error.
    """
    kind = df.schema[label].dataType if label else T.IntegerType()
    rows = df.select(F.col(id).cast("long").alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)), T.StructField("width", T.IntegerType()), T.StructField("top", T.LongType()), T.StructField("x", T.BinaryType())])

    def block(held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        lengths, values = (np.concatenate([h[i] for h in held]) for i in (2, 3))
        longest = int(lengths.max())
        x = np.zeros((len(lengths), longest), np.int32)
        x[np.arange(longest) < lengths[:, None]] = values
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        top = int(np.abs(values, dtype=np.int64).max(initial=0))
        return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([longest], pa.int32()), pa.array([top], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            of = np.repeat(np.arange(batch.num_rows), lengths)
            good = np.ones(batch.num_rows, bool) if width is None else lengths == width
            good[of[~np.isfinite(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))]] = False
            values = values[good[of]]
            if np.abs(values).max(initial=0) >= 2**31:
                raise ValueError(f"a component times {scale} isn't below 2^31")
            keep = pa.array(good)
            held.append((batch.column("id").filter(keep), batch.column("label").filter(keep), lengths[good], values.astype(np.int32)))
            n += int(good.sum())
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
                give_back()
        if n:
            yield block(held)

    return rows.mapInArrow(run, schema)


def matrix(raw: bytes, own: int, rows: int, width: int) -> np.ndarray:
    """A block's vectors as 64-bit integers, padded to a common width."""
    x = np.zeros((rows, width), np.int64)
    x[:, :own] = np.frombuffer(raw, np.int32).reshape(rows, own)
    return x


def check_range(top: int, width: int) -> None:
    """Squared distances of components up to `top` must be exact in 64 bits."""
    if 4 * max(width, 1) * max(top, 1) ** 2 >= 2**63:
        raise ValueError("components are too large for exact squared distances of 64 bits")


def squared(x: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c; as doubles where these are exact, which is faster."""
    kind = np.float64 if 4 * max(x.shape[1], 1) * max(top, 1) ** 2 < 2**53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def squared_each(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the same rows of c."""
    return ((x - c) ** 2).sum(axis=1)


def seeds(blocks: DataFrame, n: int, width: int, keys: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The n vectors with least keys (functions of the ids; the ids themselves by default), null ids last; ties go to the least components.

    Each block sends n rows at most, and what comes to the driver is n rows of `width` integers.
    """
    key_type = "string" if keys else "long"

    def least(rows: np.ndarray, x: np.ndarray, by: np.ndarray | None) -> np.ndarray:
        if by is not None and len(rows) > n:
            cut = np.partition(by, n - 1)[n - 1] if by.dtype.kind != "S" else np.sort(by)[n - 1]
            below = rows[by < cut]
            return np.concatenate((below, least(rows[by == cut], x, None)[: n - len(below)]))
        return rows[np.lexsort(x[rows].T[::-1])][:n] if len(rows) > n and x.shape[1] else rows[:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                x = matrix(batch.column("x")[i].as_py(), batch.column("width")[i].as_py(), len(ids), width)
                known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
                values = ids.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
                by = keys(values) if keys else values
                picked = least(np.arange(len(known)), x[known], by)
                key = by[picked].tolist()
                key = [k.decode() if keys else k for k in key]
                rest = least(np.flatnonzero(~np.isin(np.arange(len(ids)), known)), x, None) if len(picked) < n else []
                rows = [*known[picked].tolist(), *list(rest)[: n - len(picked)]]
                key += [None] * (len(rows) - len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string() if keys else pa.int64()), pa.array([x[r].tolist() for r in rows], pa.list_(pa.int64()))], names=["key", "x"])

    found = blocks.select("ids", "width", "x").mapInArrow(run, f"key {key_type}, x array<long>").orderBy(F.col("key").asc_nulls_last(), "x").limit(n).collect()
    return np.array([r.x for r in found], np.int64).reshape(len(found), width)


def sums_by(codes: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each of k codes has, and their componentwise sums."""
    counts, sums = np.bincount(codes, minlength=k).astype(np.int64), np.zeros((k, x.shape[1]), np.int64)
    if len(codes):
        order = np.argsort(codes, kind="stable")
        has = np.flatnonzero(counts)
        sums[has] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[has], axis=0)
    return counts, sums


def moved_sums(x: np.ndarray, rows: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> np.ndarray:
    """How the counts (first column) and sums of k entries change when `rows` go from one entry to another, or come in."""
    changed = np.ones(len(rows), bool) if before is None else before != after
    counts, sums = sums_by(after[changed], x[rows[changed]], k)
    if before is not None:
        old_counts, old_sums = sums_by(before[changed], x[rows[changed]], k)
        counts, sums = counts - old_counts, sums - old_sums
    return np.column_stack((counts, sums))


def total_change(table: DataFrame, groups: int, width: int) -> np.ndarray:
    """The sum of all blocks' changes, (groups, 1 + width): added up in each task, then by group; what comes to the driver doesn't grow with the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, 1 + width), np.int64)
        for batch in batches:
            for raw in batch.column("change"):
                total += np.frombuffer(raw.as_py(), np.int64).reshape(groups, 1 + width)
        has = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has].tolist(), pa.list_(pa.int64()))], names=["group", "change"])

    rows = table.select("change").mapInArrow(run, "group int, change array<long>")
    found = rows.groupBy("group").agg(F.array(*[F.sum(F.col("change")[i]) for i in range(1 + width)]).alias("change")).collect()
    out = np.zeros((groups, 1 + width), np.int64)
    for r in found:
        out[r.group] = r.change
    return out


def means(totals: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each entry; one without vectors stays as it was."""
    return np.where(totals[:, :1] > 0, totals[:, 1:] // np.maximum(totals[:, :1], 1), before)


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far entries have moved, rounded up."""
    return np.sqrt(squared_each(before, after).astype(np.float64)) * (1 + MARGIN)


def with_totals(rows: DataFrame, key: str, value: str, name: str, spread: Column) -> DataFrame:
    """Rows with the sum of `value` over those with an equal `key`, nulls together.

    Sums are pre-aggregated; a key that holds most rows is spread by a salt when there are too many keys to broadcast.
    """
    totals = rows.groupBy(F.col(key).alias("__key")).agg(F.sum(value).alias(name))
    if totals.limit(TOTALS + 1).count() <= TOTALS:
        return rows.join(F.broadcast(totals), rows[key].eqNullSafe(F.col("__key")), "left").drop("__key")
    totals = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__at", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(totals, rows[key].eqNullSafe(totals["__key"]) & (F.col("__at") == F.col("__salt")), "left").drop("__key", "__salt", "__at")


def by_block(table: DataFrame, schema: T.StructType, function: Callable[..., dict[str, pa.Array]], **fixed) -> DataFrame:
    """A table with, for each block, what a function of its row gives: columns by name; missing ones are kept as they are."""
    step = functools.partial(function, **fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                made = step({c: row.column(c)[0] for c in row.schema.names})
                yield pa.RecordBatch.from_arrays([made[c] if c in made else row.column(c) for c in schema.names], names=schema.names)
            give_back()

    return table.mapInArrow(run, schema)
