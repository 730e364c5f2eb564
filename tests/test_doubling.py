"""Walks by pointer doubling against walks step by step."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from territory.operators import hierarchy as h
from territory.operators.doubling import CycleError, fold, pairs
from territory.storage import children, shared_folder, tables_scope

SCHEMA = "id string, full_name string, role string, reports_to string, is_active boolean"
ROLES = [h.STATE_HEAD, h.RSM, h.DEPUTY_RSM, h.ASM, h.MR]


def forest(seed, n):
    """Users, some under an unknown manager, some inactive, in trees of any shape."""
    rng = random.Random(seed)
    up = lambda i: None if i == 0 or rng.random() < 0.05 else "gone" if rng.random() < 0.03 else f"u{rng.randrange(max(0, i - 8), i)}"
    return [(f"u{i}", f"n{i % 5}", rng.choice(ROLES), up(i), rng.random() < 0.9) for i in range(n)]


def walk(rows, only_active):
    """(id, above, depth) one step after the other."""
    known = {r[0]: r for r in rows if r[4] or not only_active}
    out = []
    for i in known:
        at, depth = i, 0
        while at in known:
            out.append((i, at, depth))
            at, depth = known[at][3], depth + 1
    return out


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 60), (3, 200)])
def test_all_pairs(spark, seed, n):
    rows = forest(seed, n)
    users = spark.createDataFrame(rows, SCHEMA)
    got = h.chains(users).select("user_id", "id", "depth").collect()
    assert sorted(map(tuple, got)) == sorted(walk(rows, False))
    got = h.closure(users).select("id", "root_id", "depth").collect()
    assert sorted(map(tuple, got)) == sorted(walk(rows, True))


def test_subtrees_and_teams(spark):
    rows = forest(4, 150)
    users, ways = spark.createDataFrame(rows, SCHEMA), walk(rows, True)
    for root in ("u0", "u7", "u149", "nobody"):
        assert sorted((r.id, r.depth) for r in h.subtree(users, root).collect()) == sorted((i, d) for i, a, d in ways if a == root)
    order = [(r.depth, r.full_name, r.id) for r in h.by_depth(users, "u0").collect()]
    assert order == sorted(order)
    reps = {r[0] for r in rows if r[2] == h.MR and r[4]}
    under, direct = Counter(a for i, a, _ in ways if i in reps), Counter(r[3] for r in rows if r[4])
    for scope in ("u0", next(r[0] for r in rows if not r[4])):  # an inactive one too
        team = [r for r in rows if r[3] == scope and r[4]]
        assert [tuple(r) for r in h.team(users, scope).collect()] == [(r[0], r[1], r[2], direct[r[0]], under[r[0]]) for r in sorted(team, key=lambda r: (r[1], r[0]))]


def test_snapshot_is_the_nearest_of_each_role(spark):
    rows = forest(5, 150)
    role = {r[0]: r[2] for r in rows}
    want = {}
    for i, a, d in sorted(walk(rows, False), key=lambda x: x[2]):
        if role[i] == h.MR:
            mine = want.setdefault(i, {})
            mine.setdefault({h.DEPUTY_RSM: h.RSM}.get(role[a], role[a]), a)
    got = h.manager_snapshot(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.mr_id: (r.asm_id, r.rsm_id, r.state_head_id) for r in got} == {i: (m.get(h.ASM), m.get(h.RSM), m.get(h.STATE_HEAD)) for i, m in want.items()}
    assert len(got) == len(want)


def test_cycles_are_named(spark):
    rows = [("a", "", h.MR, "b", True), ("b", "", h.MR, "c", True), ("c", "", h.MR, "b", True), ("d", "", h.MR, None, True), ("e", "", h.MR, "e", True), ("f", "", h.MR, "d", True)]
    users = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(CycleError) as e:
        h.chains(users)
    assert e.value.members == ["e"]
    with pytest.raises(CycleError) as e:
        h.chains(users.where("id <> 'e'"))
    assert e.value.members == ["b", "c"]
    with pytest.raises(CycleError) as e:
        h.manager_snapshot(users)
    assert set(e.value.members) <= {"b", "c", "e"}
    assert sorted(r.id for r in h.subtree(users, "d").collect()) == ["d", "f"]  # cycles elsewhere don't matter
    assert sorted(r.id for r in h.subtree(users, "c").collect()) == ["a", "b", "c"]


def test_empty(spark):
    users = spark.createDataFrame([], SCHEMA)
    assert h.chains(users).collect() == h.closure(users).collect() == h.subtree(users, "x").collect() == h.manager_snapshot(users).collect() == []


def test_a_long_chain(spark):
    """More levels than a recursive query may have."""
    n = 3000
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit(1).alias("steps"))
    found = fold(nodes, {"steps": lambda own, above: own("steps") + F.coalesce(above("steps"), F.lit(0))})
    assert found.agg(F.sum("steps"), F.max("steps")).first()[:] == (n * (n + 1) // 2, n)


def test_a_million_users(spark):
    """All ways up of 1,000,000 users, nine levels deep: more rows than a recursive query may have."""
    n, fan = 1_000_000, 5
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / fan)).alias("up"))
    with tables_scope():
        got = pairs(nodes).groupBy("depth").agg(F.count("*").alias("n"), F.sum("above_id").alias("s")).collect()
    level, want = list(range(n)), {}
    for depth in range(20):
        if not level:
            break
        want[depth] = (len(level), sum(level))
        level = [(i - 1) // fan for i in level if i > 0]
    assert {r.depth: (r.n, r.s) for r in got} == want


def test_tables_go_at_the_end_of_their_scope(spark):
    with tables_scope():
        h.subtree(spark.createDataFrame(forest(6, 20), SCHEMA), "u0").collect()
        before = children(spark, shared_folder(spark))
    assert len(children(spark, shared_folder(spark))) == len(before) - 1
