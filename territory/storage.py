"""Tables in the shared folder of the session: what a loop writes between its rounds, so that no round depends on executors that may be lost."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession

_scopes: list[list[Tables]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where the driver is the only machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="territory-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def filesystem(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Put a folder in the place of another, if there is one."""
    delete(spark, to)
    fs, at = filesystem(spark, path)
    target = filesystem(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(at, target):
        raise OSError(f"cannot move {path} to {to}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, at = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there whole or not at all."""
    fs, at = filesystem(spark, path)
    folder, name = path.rsplit("/", 1)
    draft = filesystem(spark, f"{folder}/.{name}.tmp")[1]
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(draft, at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = filesystem(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; by default they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Tables:
    """Tables under one folder. They go with drop(), at the end of a tables_scope(), or when the driver ends.

    Lean ones take less of the disk: their files are smaller, and the shuffles that made them go with their job.
    """

    def __init__(self, spark: SparkSession, lean: bool = False) -> None:
        self.spark, self.root, self.written, self.lean = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0, lean
        if _scopes:
            _scopes[-1].append(self)
        atexit.register(self._drop_at_exit)

    def write(self, df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
        path, self.written = f"{self.root}/{name}-{self.written}", self.written + 1
        self._save(df.write.partitionBy(*partition_by), path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _save(self, writer: DataFrameWriter, path: str) -> None:
        with shuffles_dropped(self.spark) if self.lean else contextlib.nullcontext():
            (writer.option("compression", "zstd") if self.lean else writer).parquet(path)

    def observed(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **metrics: Column) -> tuple[DataFrame, dict]:
        """A written table and aggregates over its rows, which the same job finds."""
        seen = Observation()
        return self.write(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name, partition_by), seen.get

    def drop(self) -> None:
        """Delete all; results that read them can't be run any more."""
        atexit.unregister(self._drop_at_exit)
        delete(self.spark, self.root)

    def _drop_at_exit(self) -> None:
        with contextlib.suppress(Py4JError, Py4JNetworkError, OSError, AttributeError):  # the session may be gone
            delete(self.spark, self.root)


@contextlib.contextmanager
def tables_scope() -> Iterator[None]:
    """Delete, at the end, all tables written inside; results must be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for tables in _scopes.pop():
            tables.drop()
