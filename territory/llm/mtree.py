"""Exact top-k by inner product with M-trees (operator 4).

Vectors x gain one component sqrt(R^2 - |x|^2), with R the largest norm, and queries q a zero: the
distance then falls as the inner product rises, and it is a metric. Vectors are dealt to
the nearest of a bounded number of routing objects, and there into rings by their distance from it. A query first visits
the ring that is nearest; the others only if they can hold a better result. Within a ring it searches an M-tree best
first: pages of entries with covering radii and distances to the parent, which rule entries out before their own distance is known.
All queries of a ring go down its tree together: where the bounds rule little out, what is left are products of matrices.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from territory.llm.base import Scratch, read_table

#: Entries in a page of a tree, routing objects, vectors in a ring and rings of a routing object, queries that visit a ring at once.
#: A routing object has at most RINGS rings, which then grow: so what is known of all rings stays below 3 MB.
PAGE, ROUTES, RING, RINGS, QUERIES = 64, 512, 8192, 256, 2048
#: Leaves that a query visits before it looks again whether the others can still hold a better result; twice as many each time.
LEAVES = 2
#: Bounds of queries and leaves that a task holds at once.
BOUNDS = 1 << 22
#: Relative slack of a bound, far above rounding errors: it only costs visits.
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=-1), 0))


class MTree:
    """An M-tree over points that one task holds, bulk loaded."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.computed = self.avoided = 0  #: distances of searches, and those that the bounds made needless
        self.root = self._page(np.arange(len(points)), points[0]) if len(points) else None

    def _page(self, rows: np.ndarray, parent: np.ndarray) -> dict:
        """A page: its entries, their distance to the parent, and of inner pages the radii and children."""
        if len(rows) <= PAGE:
            return {"rows": rows, "up": distances(self.points[rows], parent), "down": None}
        from_parent = distances(self.points[rows], parent)
        order = np.argsort(from_parent, kind="stable")
        fan = min(PAGE, 2 * -(-len(rows) // PAGE))
        picks = rows[order[np.linspace(0, len(rows) - 1, fan).astype(int)]]
        own = np.stack([distances(self.points[rows], self.points[p]) for p in picks]).argmin(axis=0)
        if np.bincount(own).max() == len(rows):  # equal points, or as good as: cut them anywhere
            own = np.arange(len(rows)) * fan // len(rows)
        groups = [(picks[i], rows[own == i]) for i in np.unique(own)]
        at = self.points[[p for p, _ in groups]]
        radii = np.array([distances(self.points[g], self.points[p]).max() for p, g in groups])
        return {"at": at, "up": distances(at, parent), "radii": radii, "down": [self._page(g, self.points[p]) for p, g in groups]}

    def search(self, query: np.ndarray, reach, offer) -> None:
        """Best first. reach(): the largest distance that still matters; offer(page, near): a leaf and its entries to look at."""
        if self.root is None:
            return
        heap, n = [(0.0, 0, self.root, float(distances(query, self.points[0])))], 0
        while heap:
            low, _, page, to_parent = heapq.heappop(heap)
            if low > reach():
                return
            most = reach() + SLACK * (1 + to_parent)
            radii = 0 if page["down"] is None else page["radii"]
            near = np.flatnonzero(np.abs(to_parent - page["up"]) - radii <= most)  # without a distance computed
            self.computed += len(near)
            self.avoided += len(page["up"]) - len(near)
            if not len(near):
                continue
            if page["down"] is None:
                offer(page, near)
                continue
            own = distances(page["at"][near], query)
            for i, d in zip(near.tolist(), own.tolist(), strict=True):
                bound = max(0.0, d - page["radii"][i] - SLACK * (1 + d))
                if bound <= most:
                    n += 1
                    heapq.heappush(heap, (bound, n, page["down"][i], d))


    def leaves(self) -> list[dict]:
        found, pages = [], [self.root] if self.root else []
        while pages:
            page = pages.pop()
            if page["down"] is None:
                page["leaf"] = len(found)
                found.append(page)
            else:
                pages += page["down"]
        return found

    def bounds(self, queries: np.ndarray, reach: np.ndarray, leaves: int) -> np.ndarray:
        """Of each query and leaf a distance that no entry there is nearer than; infinite for what lies beyond the query's reach."""
        low = np.full((len(queries), leaves), np.inf)
        if self.root is None or not len(queries):
            return low
        stack = [(self.root, np.arange(len(queries)), distances(queries, self.points[0]), np.zeros(len(queries)))]
        while stack:
            page, rows, to_parent, bound = stack.pop()
            if page["down"] is None:
                # of a leaf's entries only the distances to the parent are known
                ring = np.maximum(page["up"].min() - to_parent, to_parent - page["up"].max()) - SLACK * (1 + to_parent)
                low[rows, page["leaf"]] = np.maximum(bound, ring)
                continue
            up, far = to_parent[:, None], reach[rows, None]
            left = np.abs(up - page["up"]) - page["radii"] <= far + SLACK * (1 + up)  # without a distance computed
            self.computed += int(left.sum())
            self.avoided += int(left.size - left.sum())
            for i in np.flatnonzero(left.any(axis=0)).tolist():
                near = np.flatnonzero(left[:, i])
                d = distances(queries[rows[near]], page["at"][i])
                own = np.maximum(d - page["radii"][i] - SLACK * (1 + d), bound[near])
                in_reach = own <= far[near, 0] + SLACK * (1 + d)
                stack.append((page["down"][i], rows[near][in_reach], d[in_reach], own[in_reach]))
        low[low > reach[:, None]] = np.inf
        return low


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(-1, width) if len(column) else np.zeros((0, width), np.int64)


def _lifted(x: np.ndarray, radius2: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(radius2 - (x * x).sum(axis=1), 0))))


def _searcher(k: int, width: int, radius2: float):
    def run(queries: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        points, ids = _matrix(group["vector"], width), group["id"].to_numpy()
        asked, own_ids = _matrix(queries["vector"], width), queries["query_id"].to_numpy()
        n = len(asked)
        result = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        if not n or not len(points):
            return result
        tree = MTree(_lifted(points, radius2))
        leaves = tree.leaves()
        most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
        # products below 2^52 are exact as doubles, and much faster
        if most(points) ** 2 * width < 2**52 and most(points) * most(asked) * width < 2**52:
            points, ask = points.astype(np.float64), asked.astype(np.float64)
        else:
            ask = asked
        real = asked.astype(np.float64)
        square = (real * real).sum(axis=1)
        known = np.array([-np.inf if x is None else float(x) for x in queries["least"]])
        known[np.isnan(known)] = -np.inf
        best_scores, best_ids, held = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

        def least(rows: np.ndarray) -> np.ndarray:
            low = np.maximum(known[rows], np.where(held[rows] == k, best_scores[rows, -1], -np.inf))
            return low - np.abs(low) * 1e-15  # a large integer may have been rounded up

        def reach(rows: np.ndarray) -> np.ndarray:
            low = least(rows)
            return np.where(low == -np.inf, np.inf, np.sqrt(np.maximum(square[rows] + radius2 - 2 * np.maximum(low, -1e300), 0)) * (1 + SLACK) + SLACK)

        def visit(leaf: dict, rows: np.ndarray) -> None:
            """A leaf's entries against all queries that look into it."""
            at = ids[leaf["rows"]]
            scores = ask[rows] @ points[leaf["rows"]].T
            good = (scores >= least(rows)[:, None]) & (at != own_ids[rows, None])
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                row, new = rows[i], good[i]
                have = held[row]
                s, v = np.concatenate((best_scores[row, :have], scores[i, new].astype(np.int64))), np.concatenate((best_ids[row, :have], at[new]))
                order = np.lexsort((v, -s))[:k]
                held[row] = len(order)
                best_scores[row, : len(order)], best_ids[row, : len(order)] = s[order], v[order]

        # what is held at once doesn't grow with the ring and its visitors
        batch = max(1, min(QUERIES, BOUNDS // len(leaves)))
        for a in range(0, n, batch):
            rows = np.arange(a, min(n, a + batch))
            low = tree.bounds(np.column_stack((real[rows], np.zeros(len(rows)))), reach(rows), len(leaves))
            order = np.argsort(low, axis=1, kind="stable")
            at, step = 0, LEAVES
            while at < len(leaves) and len(rows):
                looks = order[rows - a, at : at + step]
                open_ = low[(rows - a)[:, None], looks] <= reach(rows)[:, None]
                open_ &= np.isfinite(low[(rows - a)[:, None], looks])
                who, which = np.nonzero(open_)
                chosen = looks[who, which]
                by = np.argsort(chosen, kind="stable")
                cuts = np.flatnonzero(np.diff(chosen[by], prepend=-1, append=-1))
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    visit(leaves[chosen[by[x]]], rows[who[by[x:y]]])
                rows = rows[open_.all(axis=1)]  # bounds ascend: after one that is ruled out all are
                at, step = at + step, 2 * step
        has = np.arange(k) < held[:, None]
        return pd.DataFrame({"query_id": np.repeat(own_ids, held), "vec_id": best_ids[has], "score": best_scores[has]}).astype("int64")

    return run


def topk(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k largest integer inner products of each query row with every other row.

    Components are floor(scale * x). Result: query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    Rows with a null id, a null vector or a null or non-finite component take no part; a shorter vector is
    padded with zeros; a repeated id is one more row, and never matches a query of its own id. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    real = F.col(vector).cast("array<double>")
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform(real, lambda x: F.floor(x * scale)).alias("v"), bad.alias("bad"))
    rows = scratch.write(rows.where("id is not null and v is not null and not bad").drop("bad"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, width, radius2 = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    result = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, radius2 = max(width, 1), radius2 * (1 + 1e-12)
    picks = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(ROUTES, -(-n // 1024))).select("v").collect()]
    routes = np.zeros((len(picks), width), np.int64)
    for i, v in enumerate(picks):
        routes[i, : len(v)] = v
    routes = _lifted(np.unique(routes, axis=0), radius2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest route and its distance from there."""
        for batch in batches:
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, width), np.int64)
            x[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            lifted = _lifted(x, radius2)
            away = np.stack([distances(lifted, r) for r in routes])
            own = away.argmin(axis=0)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("is_query"), pa.array(raw, pa.binary()), pa.array(own, pa.int32()), pa.array(away.min(axis=0))], names=["id", "is_query", "vector", "route", "away"])

    dealt = scratch.write(rows.mapInArrow(deal, "id long, is_query boolean, vector binary, route int, away double"), "dealt")
    scratch.drop("vectors")
    sizes = dict(dealt.groupBy("route").agg(F.count("*")).collect())  # ROUTES rows at most
    rings = max((min(RINGS, -(-c // RING)) for c in sizes.values()), default=1)
    cuts = {r.route: r.cuts for r in dealt.groupBy("route").agg(F.percentile_approx("away", [i / rings for i in range(1, rings)] or [0.5], 10_000).alias("cuts")).collect()}
    cuts = {route: sorted({found[i] for i in np.linspace(0, len(found) - 1, own).astype(int)}) if (own := min(RINGS, -(-sizes[route] // RING)) - 1) else [] for route, found in cuts.items()}
    number = np.full((len(routes), rings - 1), np.inf)
    for route, found in cuts.items():
        number[route, : len(found)] = found

    def into_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring = (batch.column("away").to_numpy()[:, None] > number[batch.column("route").to_numpy()]).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring)], names=[*batch.schema.names, "ring"])

    ringed = scratch.write(dealt.mapInArrow(into_rings, "id long, is_query boolean, vector binary, route int, away double, ring int"), "ringed")
    scratch.drop("dealt")
    known = ringed.groupBy("route", "ring").agg(F.min("away").alias("low"), F.max("away").alias("high")).orderBy("route", "ring").toArrow()  # ROUTES x RINGS rows at most
    of_route, of_ring, inner, outer = (known.column(c).to_numpy() for c in ("route", "ring", "low", "high"))

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rings that each query visits: the nearest first, later all others in reach."""
            for batch in batches:
                out = []
                for i, raw, least in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), batch.column("least").to_pylist(), strict=True):
                    q = np.frombuffer(raw, np.int64).astype(np.float64)
                    d = distances(np.append(q, 0.0), routes)[of_route]
                    low = np.maximum(np.maximum(d - outer, inner - d), 0)
                    nearest = int(np.lexsort((d, low))[0])
                    if first:
                        chosen = [nearest]
                    else:
                        reach = np.inf if least is None else np.sqrt(max((q * q).sum() + radius2 - 2 * least, 0)) * (1 + SLACK) + SLACK
                        chosen = [r for r in np.flatnonzero(low - SLACK * (1 + d) <= reach).tolist() if r != nearest]
                    out += [(i, raw, int(of_route[r]), int(of_ring[r]), least) for r in chosen]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vector", "route", "ring", "least"])

        return run

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        """Only rings that queries visit are dealt, once for each QUERIES of them."""
        asked = scratch.write(queries.mapInArrow(visits(first), "query_id long, vector binary, route int, ring int, least double"), "asked")
        chunks = scratch.write(asked.groupBy("route", "ring").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks")), "chunks")
        groups = ringed.select("id", "vector", "route", "ring").join(chunks, ["route", "ring"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        asked = asked.join(chunks, ["route", "ring"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("chunks")
        key = ["route", "ring", "chunk"]
        return asked.groupBy(key).cogroup(groups.groupBy(key)).applyInPandas(_searcher(k, width, radius2), result)

    asked = ringed.where("is_query").select("id", "vector").dropDuplicates(["id", "vector"])
    near = scratch.write(ranked(visit(asked.withColumn("least", F.lit(None).cast("double")), True)).drop("rank"), "near")
    least = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    others = visit(asked.join(least, F.col("id") == F.col("query_id"), "left").select("id", "vector", "least"), False)
    return ranked(near.unionByName(others)).select("query_id", "rank", "vec_id", "score")


def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
