"""Helpers that the operators of this package share: scratch tables, hashing of words, batching."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once, if one text isn't longer; arrays take about 10 times as much.
CHUNK_BYTES = 1 << 20
#: Bytes or words that are hashed at once, so that a long text needs no long tables.
PIECE = 1 << 17
#: Bytes of a batch between Spark and Python, where the session has Spark's own 64 MB: a batch is held on both sides.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, 64 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z lower-cased, other ASCII characters that aren't letters or digits as spaces.
TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in _LOWER)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key, str(SPARK_BATCH_BYTES)))) == SPARK_BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a local one only where the driver is the only machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="territory-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of a frame with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items())])


_scopes: list[list[Scratch]] = []


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete, at the end, all tables that operators called inside have written; results must be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.drop_all()


class Scratch:
    """Tables written to the shared folder, so that later stages don't depend on executors that may be lost."""

    def __init__(self, spark: SparkSession) -> None:
        small_batches(spark)
        self.spark, self.root = spark, f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.tables: list[str] = []  # names that the catalog has of some of them
        self.written = 0
        if _scopes:
            _scopes[-1].append(self)

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path, self.written = f"{self.root}/{name}-{self.written}", self.written + 1
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        if name in self.paths:  # an earlier table of this name, which is still to be dropped
            self.paths[f"{name}-{self.written}"] = self.paths[name]
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Delete tables that no later result reads."""
        for name in names:
            self._delete(self.paths.pop(name))

    def drop_all(self) -> None:
        """Delete what is left; results that read it can't be run any more."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.paths.clear()
        self._delete(self.root)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder -1, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on while its executor does other work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            done, at = int(size[to - 1]), to
        del batch, size
        give_back()


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def parts(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A long text cut at ASCII white space."""
    at = 0
    while at < len(text):
        found = _GAP.search(text, at + size)
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table))
    return tables[0], tables[1]


_kept_power_tables = functools.cache(_power_tables)


def power_tables(n: int = PIECE + 1) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of the base of polynomial hashes and of its inverse; long tables aren't kept."""
    return _kept_power_tables(PIECE + 1) if n <= PIECE + 1 else _power_tables(n)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of many texts: byte spans in one buffer and the first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False, table: bytes | None = None) -> None:
        self.raw = b"\n".join(texts) + b"\n"
        if lower or table:
            self.raw = self.raw.translate(table or _LOWER)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        gap = _SEPARATOR[self.bytes]
        edges = np.flatnonzero(np.diff(gap)) + 1
        if not gap[0]:
            edges = np.concatenate(([0], edges))
        self.start, self.end = edges[0::2], edges[1::2]
        begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts]))).astype(np.int64)
        self.first = np.searchsorted(self.start, begin)  # words of text i: first[i] .. first[i + 1]
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its bytes up to `end`: a polynomial over the bytes, from prefix sums of pieces."""
        end, (up, down) = self.end if end is None else end, power_tables()
        total = np.zeros(len(self), np.uint64)
        sums = np.zeros(PIECE + 1, np.uint64)
        for at in range(0, len(self.bytes), PIECE):
            part = self.bytes[at : at + PIECE]
            np.cumsum(_BYTE_VALUE[part] * up[: len(part)], out=sums[1 : len(part) + 1])
            low, high = np.searchsorted(self.end, at, side="right"), np.searchsorted(self.start, at + len(part))
            if low < high:
                from_ = np.maximum(self.start[low:high], at) - at
                to = np.maximum(np.minimum(end[low:high], at + len(part)) - at, from_)
                own = (sums[to] - sums[from_]) * down[from_]
                if self.start[low] < at:  # the only word that began in an earlier piece
                    own[:1] *= np.uint64(pow(_BASE, int(at - self.start[low]), 1 << 64))
                total[low:high] += own
        return mix(total + (end - self.start).astype(np.uint64))

    def hashes_and_stems(self, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and of their first few bytes, where they are longer, each with its text."""
        of = self.text_of_word()
        hashes, texts = [self.hashes()], [of]
        for width in widths:
            longer = self.end - self.start > width
            stems = self.hashes(np.minimum(self.end, self.start + width))
            hashes.append(mix(stems[longer] + np.uint64(width)))
            texts.append(of[longer])
        return np.concatenate(hashes), np.concatenate(texts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of `width` hashes, by its first; the last width - 1 positions have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = max(PIECE, 4 * width)
    (up, down), out = power_tables(size + 1), np.empty(n, np.uint64)
    sums = np.zeros(size + 1, np.uint64)
    for at in range(0, n, size - width + 1):
        part = hashes[at : at + size]
        np.cumsum(part * up[: len(part)], out=sums[1 : len(part) + 1])
        m = len(part) - width + 1
        out[at : at + m] = mix((sums[width : len(part) + 1] - sums[:m]) * down[:m])
    return out
