"""Vector codes by Lloyd's rounds with heaps (operator 11).

A vector is cut into equal parts, each with a codebook of its own. In a block of vectors every entry of a codebook has a
heap of the parts assigned to it, keyed by the slack between the lower bound of the distance to any other entry
and the upper bound of the distance to their own. When entries move, the slack of all parts of an entry shrinks by the same amount: that entry's
drift and the largest drift of another. So only what has drifted in all is kept for an entry, and only parts whose key it has reached
are popped and compared with all entries again.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from territory.llm.base import Scratch, read_table
from territory.llm.vectors import MARGIN, by_block, check_range, drifts, matrix, means, moved_sums, packed, seeds, squared, squared_each, total_change, with_totals

STATE = (("members", T.BinaryType()), ("keys", T.BinaryType()), ("sizes", T.BinaryType()), ("change", T.BinaryType()), ("scanned", T.LongType()))


class Heaps:
    """One heap for each entry of a codebook, of (key, part); only those that are touched are unpacked."""

    def __init__(self, members: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> None:
        self.members, self.keys, self.sizes = members, keys, sizes
        self.ends = np.cumsum(sizes)
        self.open: dict[int, list[tuple[float, int]]] = {}

    def _heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.open:
            a, b = self.ends[entry] - self.sizes[entry], self.ends[entry]
            self.open[entry] = list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist(), strict=True))
        return self.open[entry]

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts whose key their entry's drift has reached, and their entries: first the roots are looked at."""
        parts, entries = [], []
        has = np.flatnonzero(self.sizes)
        for entry in has[self.keys[(self.ends - self.sizes)[has]] <= drift[has]].tolist():
            heap, most = self._heap(entry), drift[entry]
            while heap and heap[0][0] <= most:
                parts.append(heapq.heappop(heap)[1])
                entries.append(entry)
        return np.array(parts, np.int64), np.array(entries, np.int64)

    def push(self, parts: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        for part, entry, key in zip(parts.tolist(), entries.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self._heap(entry), (key, part))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The heaps as they lie, one after the other."""
        members, keys, sizes = [], [], self.sizes.copy()
        for entry in range(len(sizes)):
            if entry in self.open:
                heap = self.open[entry]
                keys.append(np.array([k for k, _ in heap], np.float64))
                members.append(np.array([m for _, m in heap], np.int32))
                sizes[entry] = len(heap)
            else:
                a, b = self.ends[entry] - self.sizes[entry], self.ends[entry]
                keys.append(self.keys[a:b])
                members.append(self.members[a:b])
        return np.concatenate(members), np.concatenate(keys), sizes

    def codes(self) -> np.ndarray:
        members, _, sizes = self.arrays()
        out = np.empty(len(members), np.int64)
        out[members] = np.repeat(np.arange(len(sizes)), sizes)
        return out


def nearest(x: np.ndarray, book: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, the least of equals, and its slack, rounded down."""
    away = squared(x, book, top)
    best = away.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(away[rows, best].astype(np.float64))
    if len(book) == 1:
        return best, np.full(len(x), math.inf)
    lower = np.sqrt(np.partition(away, 1, axis=1)[:, 1].astype(np.float64))
    return best, lower - upper - MARGIN * (lower + upper)


def _assigned(row: dict, books: np.ndarray, drift: np.ndarray | None, width: int, top: int) -> tuple[np.ndarray, list[Heaps], list[np.ndarray], int]:
    """The block's vectors, its heaps after one assignment, the changes of sums and the number of parts compared with all entries."""
    n, (parts, k, _) = len(row["ids"].values), books.shape
    x = matrix(row["x"].as_py(), row["width"].as_py(), n, width)
    heaps, changes, scanned = [], [], 0
    for p, (book, own) in enumerate(zip(books, np.split(x, parts, axis=1), strict=True)):
        if drift is None:
            h = Heaps(np.zeros(0, np.int32), np.zeros(0), np.zeros(k, np.int64))
            again, before = np.arange(n), None
        else:
            members, keys, sizes = (np.frombuffer(row[c].as_py(), t).reshape(parts, -1)[p] for c, t in (("members", np.int32), ("keys", np.float64), ("sizes", np.int64)))
            h = Heaps(members, keys, sizes)
            again, before = h.pop(drift[p])
        best, slack = nearest(own[again], book, top)
        key = slack if drift is None else slack + drift[p][best] - MARGIN * (np.abs(slack) + drift[p][best])
        h.push(again, best, key)
        scanned += len(again)
        changes.append(moved_sums(own, again, before, best, k))
        heaps.append(h)
    return x, heaps, changes, scanned


def _round(row: dict, books: np.ndarray, drift: np.ndarray | None, width: int, top: int) -> dict[str, pa.Array]:
    _, heaps, changes, scanned = _assigned(row, books, drift, width, top)
    state = [np.stack(x).tobytes() for x in zip(*(h.arrays() for h in heaps), strict=True)]
    made = dict(zip(("members", "keys", "sizes"), state, strict=True)) | {"change": np.concatenate(changes).tobytes()}
    return {c: pa.array([v], pa.binary()) for c, v in made.items()} | {"scanned": pa.array([scanned], pa.int64())}


def _coded(row: dict, books: np.ndarray, drift: np.ndarray | None, width: int, top: int) -> dict[str, pa.Array]:
    x, heaps, _, _ = _assigned(row, books, drift, width, top)
    codes = [h.codes() for h in heaps]
    error = sum(squared_each(own, book[c]) for own, book, c in zip(np.split(x, len(books), axis=1), books, codes, strict=True))
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])], object)
    text = sum((digits[c] for c in codes[1:]), digits[codes[0]])
    listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return {"code": listed(pa.array(text, pa.string())), "error": listed(pa.array(error, pa.int64()))}


def compress(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: float = 1024.0, parts: int = 4, entries: int = 256, rounds: int = 4
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codes of all vectors, the codebooks (parts, entries, components), and how many parts each round compared with all entries.

    Components are floor(scale * x). Codebooks start as the parts of the vectors with the least ids; each of `rounds` rounds assigns
    every part to the nearest entry and replaces entries by the floor of their parts' means; then parts are assigned again. The frame has
    (id, label, code, error): two hex digits for each part, and the squared distance to what the code stands for.

    Rows whose vector is null or holds null or non-finite components are dropped. Ties go to the lower entry; entries without
    parts stay. Repeated rows count each; of equal ids the least components come first among the seeds, null ids last.
    A vector that is shorter than the longest, or whose length `parts` doesn't divide, is padded with zeros. With fewer vectors
    than entries the codebooks are as short. An empty table gives an empty frame and codebooks without entries.
    Components must be below 2^31 after scaling, and squared distances must fit in 64 bits, or the job fails. Other columns
    aren't read.

    The codebooks, entries x components numbers, are all that the driver holds.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    scratch = Scratch(df.sparkSession)
    blocks = scratch.write(packed(df, id, vector, scale, label), "blocks")
    longest, top = blocks.agg(F.max("width"), F.max("top")).first()
    width = -(-(longest or 0) // parts) * parts
    check_range(top or 0, width)
    books = np.stack(np.split(seeds(blocks, entries, width), parts, axis=1))
    k, own = books.shape[1], width // parts
    state = T.StructType([*blocks.schema.fields, *(T.StructField(c, t) for c, t in STATE)])
    totals, drift, table, scans = np.zeros((parts * k, 1 + own), np.int64), None, blocks, []
    for turn in range(rounds if k else 0):
        after = scratch.write(by_block(table, state, _round, books=books, drift=drift, width=width, top=top), f"round{turn}")
        scratch.drop("blocks" if table is blocks else f"round{turn - 1}")
        table = after
        scans.append(table.agg(F.sum("scanned")).first()[0])
        totals += total_change(table, parts * k, own)
        moved = means(totals, books.reshape(parts * k, own)).reshape(books.shape)
        drift = np.zeros((parts, k)) if drift is None else drift
        for p in range(parts):
            far = drifts(books[p], moved[p])
            order = np.argsort(far)
            most = np.full(k, far[order[-1]])  # the largest drift of another entry
            most[order[-1]] = far[order[-2]] if k > 1 else 0
            drift[p] = (drift[p] + far + most) * (1 + MARGIN)
        books = moved
    schema = T.StructType([*(f for f in blocks.schema.fields if f.name in ("ids", "labels")), T.StructField("code", T.ArrayType(T.StringType())), T.StructField("error", T.ArrayType(T.LongType()))])
    coded = by_block(table, schema, _coded, books=books, drift=drift, width=width, top=top)
    coded = coded.select(F.explode(F.arrays_zip("ids", "labels", "code", "error")).alias("r"))
    coded = scratch.write(coded.select(F.col("r.ids").alias("id"), F.col("r.labels").alias("label"), "r.code", "r.error"), "coded")
    scratch.drop(f"round{rounds - 1}" if table is not blocks else "blocks")
    return coded, books, scans


def op11_heap_lloyd(spark, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(read_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_totals(coded, "label", "error", "label_error", F.col("id")).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op11_sql(rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.n, p.p, p.label, any_value(p.x) AS x, min({{'d': CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT), 'e': c.e}}) AS best"
            f" FROM parts p JOIN c{r} c ON p.p = c.p GROUP BY p.vec_id, p.n, p.p, p.label)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT p, e, list(floor(total / count) ORDER BY i) AS x FROM (SELECT p, best.e AS e, i, sum(x[i]) AS total, count(*) AS count FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL) GROUP BY p, e),"
                f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)"
            )
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS n FROM v),
parts AS MATERIALIZED (SELECT vec_id, label, n, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM n, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, n AS e, x FROM parts WHERE n < 256),
{",".join(steps)},
coded AS (SELECT vec_id, n, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, n, label),
hash AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, hash
"""


OP11_SQL = _op11_sql()
