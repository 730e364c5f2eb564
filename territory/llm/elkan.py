"""Clusters around centroids with Elkan's bounds (operator 13).

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to each centroid. When
centroids move, bounds move by their drift; a distance is only computed where the bounds and the distances between centroids
leave open which is nearer. Bounds are rounded outwards and rule a centroid out only if it is strictly farther, so that ties are
seen; what is compared in the end are exact integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from territory.llm.base import Scratch, read_table
from territory.llm.vectors import MARGIN, by_block, check_range, drifts, matrix, means, moved_sums, packed, seeds, squared, squared_each, total_change

STATE = (("own", T.BinaryType()), ("upper", T.BinaryType()), ("lower", T.BinaryType()), ("change", T.BinaryType()), ("computed", T.LongType()))


def above(x: np.ndarray) -> np.ndarray:
    """As single precision, rounded up."""
    return np.nextafter((x * (1 + MARGIN)).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    """As single precision, rounded down, 0 at least."""
    return np.maximum(np.nextafter((x * (1 - MARGIN)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def assign(x: np.ndarray, centroids: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (the least of equals), bounds, and the number of distances computed.

    `upper` and `lower` are valid bounds before; only what they leave open is computed.
    """
    own, upper, lower, computed = own.copy(), upper.copy(), lower.copy(), 0
    between = np.sqrt(squared(centroids, centroids, int(np.abs(centroids).max(initial=0))).astype(np.float64))
    half = between / 2 * (1 - MARGIN)
    np.fill_diagonal(half, np.inf)
    open_ = np.flatnonzero(upper >= half[own].min(axis=1))  # no other centroid can be as near as the own one beyond this
    best = np.zeros(len(x), np.int64)  # exact, where `known`
    known = np.zeros(len(x), bool)

    def learn(rows: np.ndarray) -> None:
        """The exact distance to the own centroid."""
        nonlocal computed
        best[rows] = squared_each(x[rows], centroids[own[rows]])
        far = np.sqrt(best[rows].astype(np.float64))
        upper[rows], lower[rows, own[rows]], known[rows] = above(far), below(far), True
        computed += len(rows)

    for j in range(len(centroids)):
        maybe = open_[own[open_] != j]
        maybe = maybe[(upper[maybe] >= lower[maybe, j]) & (upper[maybe] >= half[own[maybe], j])]
        learn(maybe[~known[maybe]])
        maybe = maybe[(upper[maybe] >= lower[maybe, j]) & (upper[maybe] >= half[own[maybe], j])]
        away = squared_each(x[maybe], centroids[j])
        far = np.sqrt(away.astype(np.float64))
        computed += len(maybe)
        lower[maybe, j] = below(far)
        nearer = (away < best[maybe]) | ((away == best[maybe]) & (j < own[maybe]))
        to = maybe[nearer]
        own[to], best[to], upper[to] = j, away[nearer], above(far[nearer])
    return own, upper, lower, computed


def _assigned(row: dict, centroids: np.ndarray, drift: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray | None, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    n, k = len(row["ids"].values), len(centroids)
    x = matrix(row["x"].as_py(), row["width"].as_py(), n, width)
    if drift is None:
        return x, None, assign(x, centroids, np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32))
    own, upper, lower = np.frombuffer(row["own"].as_py(), np.uint16).astype(np.int64), np.frombuffer(row["upper"].as_py(), np.float32), np.frombuffer(row["lower"].as_py(), np.float32).reshape(n, k)
    return x, own, assign(x, centroids, own, above(upper.astype(np.float64) + drift[own]), below(lower.astype(np.float64) - drift))


def _round(row: dict, centroids: np.ndarray, drift: np.ndarray | None, width: int) -> dict[str, pa.Array]:
    x, before, (own, upper, lower, computed) = _assigned(row, centroids, drift, width)
    change = moved_sums(x, np.arange(len(x)), before, own, len(centroids))
    made = {"own": own.astype(np.uint16), "upper": upper, "lower": lower, "change": change}
    return {c: pa.array([v.tobytes()], pa.binary()) for c, v in made.items()} | {"computed": pa.array([computed], pa.int64())}


def _clustered(row: dict, centroids: np.ndarray, drift: np.ndarray | None, width: int) -> dict[str, pa.Array]:
    x, _, (own, *_) = _assigned(row, centroids, drift, width)
    listed = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t))
    return {"cluster": listed(own, pa.int32()), "distance": listed(squared_each(x, centroids[own]), pa.int64())}


def seed_keys(ids: np.ndarray) -> np.ndarray:
    return np.array([hashlib.sha256(b"1:%d" % i).hexdigest() for i in ids.tolist()], "S64")


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, width: int = 64, k: int = 16, rounds: int = 3) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, cluster, distance) of all vectors, the centroids (k, width), and how many distances to centroids each round computed.

    Components are floor(scale * x). Centroids start as the k vectors whose id has the least sha256 of `1:<id>`; each of `rounds`
    rounds assigns every vector to the nearest centroid and replaces centroids by the floor of their vectors' means; then vectors are
    assigned again. Distances are squared.

    Kept are vectors of exactly `width` components, none null or non-finite. Ties go to the smaller number; empty centroids
    stay. Repeated rows count each; of equal ids the least components come first among the seeds, null ids last. With
    fewer vectors than k there are as few centroids. An empty table gives an empty frame and no centroids. Components must be below
    2^31 after scaling, and squared distances must fit in 64 bits, or the job fails. Other columns aren't read.

    The centroids, k x width numbers, are all that the driver holds.
    """
    if not 1 <= k <= 1 << 16:
        raise ValueError("1 to 65,536 centroids")
    scratch = Scratch(df.sparkSession)
    blocks = scratch.write(packed(df, id, vector, scale, width=width), "blocks")
    check_range(blocks.agg(F.max("top")).first()[0] or 0, width)
    centroids = seeds(blocks, k, width, seed_keys)
    k = len(centroids)
    state = T.StructType([*blocks.schema.fields, *(T.StructField(c, t) for c, t in STATE)])
    totals, drift, table, counts = np.zeros((k, 1 + width), np.int64), None, blocks, []
    for turn in range(rounds if k else 0):
        after = scratch.write(by_block(table, state, _round, centroids=centroids, drift=drift, width=width), f"round{turn}")
        scratch.drop("blocks" if table is blocks else f"round{turn - 1}")
        table = after
        counts.append(table.agg(F.sum("computed")).first()[0])
        totals += total_change(table, k, width)
        moved = means(totals, centroids)
        drift, centroids = drifts(centroids, moved), moved
    schema = T.StructType([*(f for f in blocks.schema.fields if f.name == "ids"), T.StructField("cluster", T.ArrayType(T.IntegerType())), T.StructField("distance", T.ArrayType(T.LongType()))])
    found = by_block(table, schema, _clustered, centroids=centroids, drift=drift, width=width).select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r"))
    found = scratch.write(found.select(F.col("r.ids").alias("id"), "r.cluster", "r.distance"), "clustered")
    scratch.drop(f"round{rounds - 1}" if table is not blocks else "blocks")
    return found, centroids, counts


def op13_elkan(spark, sf_dir: str) -> DataFrame:
    found, centroids, _ = cluster(read_table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql(rounds: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.n, any_value(v.x) AS x, min({{'d': CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT), 'c': c.c}}) AS best"
            f" FROM n v CROSS JOIN c{r} c GROUP BY v.vec_id, v.n)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT c, list(floor(total / count) ORDER BY i) AS x FROM (SELECT best.c AS c, i, sum(x[i]) AS total, count(*) AS count FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c),"
                f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)"
            )
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS n FROM v),
c0 AS (SELECT n AS c, x FROM n WHERE n < 16),
{",".join(steps)}
SELECT vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c
"""


OP13_SQL = _op13_sql()
