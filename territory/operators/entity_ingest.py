"""Master data from pool sheets: stockists, headquarters, stores, doctors and their links, found or made anew.

Running an ingest twice changes nothing the second time: every phase inserts only what isn't there. New ids are
hashes of what identifies a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territory.functions import text as t
from territory.operators.merge import insert_ignore


def new_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256).substr(1, 32)


def keyed(rows: DataFrame) -> DataFrame:
    """A sheet's rows with the keys and words of their names, which all phases ask for; rows that have them stay as they are."""
    if "__doctor_key" in rows.columns:
        return rows
    return rows.withColumns({
        "__stockist_key": t.stockist_key(F.col("stockist_name")), "__stockist": t.stockist_name(F.col("stockist_name")), "__hq_key": t.hq_key(F.col("headquarter")), "__hq": t.clean_whitespace(F.col("headquarter")),
        "__tokens": t.store_tokens(F.col("chemist_name")), "__doctor_key": t.doctor_key(F.col("doctor_name")), "__rep_key": F.upper(t.clean_whitespace(F.col("fso_name"))),
    })


def resolve_stockists(rows: DataFrame, stockists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key to id, new stockists): active stockists by key, the others made, one for each key with its first name."""
    asked = keyed(rows).select("row_index", F.col("__stockist_key").alias("key"), F.col("__stockist").alias("name")).where("key <> ''")
    have = stockists.where("is_active").groupBy(t.stockist_key(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    asked = asked.groupBy("key").agg(F.min_by("name", "row_index").alias("name"))
    new = asked.join(have, "key", "left_anti").select("key", new_id(F.lit("stockist"), "key").alias("id"), "name", F.lit(True).alias("is_active"))
    return have.unionByName(new.select("key", "id")), new


def resolve_headquarters(rows: DataFrame, headquarters: DataFrame, state_id: str | None, division_ids: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key to id, new headquarters, warnings): made only if a default state and divisions are given."""
    asked = keyed(rows).select("row_index", F.col("__hq_key").alias("key"), F.col("__hq").alias("name")).where("key <> ''")
    asked = asked.groupBy("key").agg(F.min_by("name", "row_index").alias("name"), F.min("row_index").alias("row_index"))
    have = headquarters.groupBy(t.hq_key(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    lacking = asked.join(have, "key", "left_anti")
    if state_id is None or not division_ids:
        return have, lacking.limit(0).select("key", F.col("name").alias("id"), "name"), lacking.select("row_index", F.lit("unknown headquarter").alias("kind"), "name")
    new = lacking.select("key", new_id(F.lit("hq"), "key").alias("id"), "name", F.lit(state_id).alias("state_id"), F.array(*map(F.lit, division_ids)).alias("division_ids"), F.lit(True).alias("is_active"))
    return have.unionByName(new.select("key", "id")), new, lacking.limit(0).select("row_index", F.lit("").alias("kind"), "name")


def compatible(a: Column, b: Column) -> Column:
    """Whether one set of words holds the other, which has two words at least, or they are equal."""
    inside = lambda x, y: (F.size(x) >= 2) & (F.size(F.array_except(x, y)) == 0)
    return (a == b) | inside(a, b) | inside(b, a)


def held_in(small: DataFrame, big: DataFrame, scope: list[str]) -> DataFrame:
    """small's columns with those of big's rows in the scope whose `big_tokens` hold all its `tokens`.

    They meet by the word of the small set that fewest big sets have, so that a common word doesn't bring all sets of a scope together.
    """
    words = big.withColumn("word", F.explode("big_tokens"))
    own = small.withColumn("word", F.explode("tokens")).join(words.groupBy(*scope, "word").agg(F.count("*").alias("__n")), [*scope, "word"], "left")
    rare = own.groupBy(*small.columns).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "word")).alias("__rare")).withColumn("word", F.col("__rare.word")).drop("__rare")
    return rare.join(words, [*scope, "word"]).where(F.size(F.array_except("tokens", "big_tokens")) == 0).drop("word")


def cluster_stores(named: DataFrame) -> DataFrame:
    """(stockist_id, headquarter_id, tokens, cluster): each set of words of a scope with the set it merges into.

    A set of two words or more merges into the first set that holds it: the largest, by first appearance among equals. That
    is one that merges into no other, as what held that one would hold both and come before. `named` has stockist_id,
    headquarter_id, tokens, row_index.
    """
    scope = ["stockist_id", "headquarter_id"]
    sets = named.groupBy(*scope, "tokens").agg(F.min("row_index").alias("row_index"))
    big = sets.select(*scope, F.col("tokens").alias("big_tokens"), F.struct((-F.size("tokens")).alias("n"), "row_index").alias("place"))
    held = held_in(sets.where("size(tokens) >= 2").drop("row_index"), big, scope)
    first = held.groupBy(*scope, "tokens").agg(F.min_by("big_tokens", "place").alias("cluster"))
    return sets.join(first, [*scope, "tokens"], "left").select(*scope, "tokens", F.coalesce("cluster", "tokens").alias("cluster"))


def group_stores(rows: DataFrame, stockist_ids: DataFrame, hq_ids: DataFrame) -> DataFrame:
    """Store groups of a sheet: scope, cluster, canonical name, all names, first address and the rows."""
    named = keyed(rows).where("chemist_name <> ''").withColumns({"sk": F.col("__stockist_key"), "hk": F.col("__hq_key"), "tokens": F.col("__tokens")}).where("size(tokens) > 0")
    named = named.join(stockist_ids.select(F.col("key").alias("sk"), F.col("id").alias("stockist_id")), "sk").join(hq_ids.select(F.col("key").alias("hk"), F.col("id").alias("headquarter_id")), "hk")
    scope = ["stockist_id", "headquarter_id"]
    placed = named.join(cluster_stores(named.select(*scope, "tokens", "row_index")), [*scope, "tokens"])
    address = F.coalesce(F.nullif(F.trim("chemist_location"), F.lit("")), F.nullif(F.trim("doctor_address"), F.lit("")))
    return placed.groupBy(*scope, "cluster").agg(
        F.min(t.name_rank(F.col("chemist_name"))).alias("best"), F.array_sort(F.collect_set("chemist_name")).alias("names"), F.min_by(address, F.when(address.isNotNull(), F.col("row_index"))).alias("address"), F.array_sort(F.collect_set("row_index")).alias("rows")
    ).withColumn("name", F.col("best.name")).drop("best")


def match_stores(groups: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups with their store's id, new stores, aliases to add): by compatible names or aliases within the scope.

    Inactive stores count too. Of several stores the one with the least id is taken.
    """
    scope = ["stockist_id", "headquarter_id"]
    names = stores.select(F.col("id").alias("store_id"), *scope, F.explode(F.concat(F.array("name"), F.coalesce("alternate_names", F.array().cast("array<string>")))).alias("known"))
    names = names.select("store_id", *scope, t.store_tokens(F.col("known")).alias("known")).where("size(known) > 0")
    clusters, sets = groups.select(*scope, F.col("cluster").alias("tokens")), names.select(*scope, F.col("known").alias("tokens")).distinct()
    pairs = held_in(clusters, sets.withColumnRenamed("tokens", "big_tokens"), scope).select(*scope, F.col("tokens").alias("cluster"), F.col("big_tokens").alias("known"))
    pairs = pairs.unionByName(held_in(sets, clusters.withColumnRenamed("tokens", "big_tokens"), scope).select(*scope, F.col("big_tokens").alias("cluster"), F.col("tokens").alias("known")))
    pairs = pairs.where(compatible(F.col("cluster"), F.col("known"))).distinct()
    near = pairs.join(names, [*scope, "known"]).groupBy(*scope, "cluster").agg(F.min("store_id").alias("store_id"))
    placed = groups.join(near, [*scope, "cluster"], "left")
    new = placed.where("store_id is null").select(new_id(F.lit("store"), *scope, F.array_join("cluster", " ")).alias("id"), "name", *scope, "address", F.array_except("names", F.array("name")).alias("alternate_names"), F.lit(True).alias("is_active"))
    placed = placed.withColumn("store_id", F.coalesce("store_id", new_id(F.lit("store"), *scope, F.array_join("cluster", " "))))
    aliases = placed.join(new.select(F.col("id").alias("store_id")), "store_id", "left_anti").select(F.col("store_id").alias("id"), F.explode("names").alias("name"))
    return placed, new, aliases


def group_doctors(rows: DataFrame, hq_ids: DataFrame) -> DataFrame:
    """Doctors of a sheet by name and headquarter, with the first phone, specialty, degree and address that are given."""
    named = keyed(rows).withColumns({"key": F.col("__doctor_key"), "hk": F.col("__hq_key")}).where("key <> ''")
    named = named.join(hq_ids.select(F.col("key").alias("hk"), F.col("id").alias("headquarter_id")), "hk", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("row_index"))).alias(c)
    return named.groupBy("key", "headquarter_id").agg(F.min_by("doctor_name", "row_index").alias("full_name"), first("contact"), first("specialty"), first("degree"), first("doctor_address"), F.array_sort(F.collect_set("row_index")).alias("rows"))


def match_doctors(groups: DataFrame, doctors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups with their doctor's id, new doctors, promotions): the same headquarter first, then none, then any that the sheet names.

    Of groups of one name that nobody matches the first makes the doctor, whom the others share. A doctor without a headquarter takes
    that of the first group that has one (a promotion, or at once for a new doctor).
    """
    named = groups.where("headquarter_id is not null").select(F.col("headquarter_id").alias("of")).distinct()
    have = doctors.select(F.col("id").alias("doctor_id"), t.doctor_key(F.col("full_name")).alias("key"), F.col("headquarter_id").alias("of"))
    have = have.where("of is null").unionByName(have.join(named, "of", "left_semi"))
    rank = F.when(F.col("of").eqNullSafe(F.col("headquarter_id")), 0).when(F.col("of").isNull(), 1).otherwise(2)
    best = groups.select("key", "headquarter_id").join(have, "key").groupBy("key", "headquarter_id").agg(F.min(F.struct(rank.alias("rank"), "doctor_id", "of")).alias("b"))
    best = best.select("key", F.col("headquarter_id").alias("h"), F.col("b.doctor_id").alias("doctor_id"), F.col("b.rank").alias("rank"))
    placed = groups.alias("g").join(best.alias("b"), (F.col("g.key") == F.col("b.key")) & F.col("headquarter_id").eqNullSafe(F.col("h")), "left").select("g.*", "doctor_id", "rank").withColumn("first", F.array_min("rows"))
    made = new_id(F.lit("doctor"), "key", F.coalesce("headquarter_id", F.lit("")))
    one = F.struct(made.alias("id"), "full_name", F.col("specialty").alias("specialization"), F.col("degree").alias("qualification"), F.col("contact").alias("phone"), F.col("doctor_address").alias("address"))
    where = F.min_by("headquarter_id", F.when(F.col("headquarter_id").isNotNull(), F.col("first")))
    new = placed.where("doctor_id is null").groupBy("key").agg(F.min_by(one, "first").alias("d"), where.alias("headquarter_id"))
    shared = new.select("key", F.col("d.id").alias("__made"))
    promoted = placed.where("rank = 1 and headquarter_id is not null").groupBy(F.col("doctor_id").alias("id")).agg(F.min_by("headquarter_id", "first").alias("headquarter_id"))
    placed = placed.join(shared, "key", "left").withColumn("doctor_id", F.coalesce("doctor_id", "__made")).drop("rank", "first", "__made")
    return placed, new.select("d.*", "headquarter_id", F.lit(True).alias("is_active")), promoted


def link(doctor_groups: DataFrame, store_groups: DataFrame, links: DataFrame) -> DataFrame:
    """New pairs (doctor_id, medical_store_id) of rows that name both."""
    d = doctor_groups.select("doctor_id", F.explode("rows").alias("row_index"))
    s = store_groups.select(F.col("store_id").alias("medical_store_id"), F.explode("rows").alias("row_index"))
    return insert_ignore(links, d.join(s.hint("merge"), "row_index").select("doctor_id", "medical_store_id"), ["doctor_id", "medical_store_id"])


def allocate(rows: DataFrame, doctor_groups: DataFrame, users: DataFrame, caller: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allocations (mr_id, doctor_id, allocated_by, is_active), placeholder reps, warnings): reps by name.

    An unknown name makes a placeholder rep; a name that several reps have is skipped with a warning.
    """
    asked = keyed(rows).select("row_index", F.col("__rep_key").alias("key"), "fso_name").where("key <> ''")
    reps = users.where("role = 'MR'").groupBy(F.upper(t.clean_whitespace(F.col("full_name"))).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("mr_id"))
    placed = asked.join(reps, "key", "left")
    made = new_id(F.lit("mr"), "key")
    slug = F.regexp_replace(F.lower("key"), "[^a-z0-9]+", "-")
    new = placed.where("n is null").groupBy("key").agg(F.min_by("fso_name", "row_index").alias("full_name")).select(made.alias("id"), "full_name", F.lit("MR").alias("role"), F.concat(F.substring(slug, 1, 40), F.lit("."), F.substring(F.sha2("key", 256), 1, 8), F.lit("@placeholder.invalid")).alias("email"), F.lit(True).alias("is_active"))
    warnings = placed.where("n > 1").select("row_index", F.lit("several reps have this name").alias("kind"), F.col("fso_name").alias("name"))
    one = placed.where("n is null or n = 1").select("row_index", F.coalesce("mr_id", made).alias("mr_id"))
    d = doctor_groups.select("doctor_id", "headquarter_id", F.explode("rows").alias("row_index"))
    pairs = one.join(d.hint("merge"), "row_index").select("mr_id", "doctor_id", F.lit(caller).alias("allocated_by"), F.lit(True).alias("is_active")).distinct()
    return pairs, new, warnings


def allocate_headquarters(allocations: DataFrame, doctors: DataFrame, existing: DataFrame, caller: str) -> DataFrame:
    """New (mr_id, headquarter_id) allocations from the doctors' headquarters; active ones aren't made again."""
    of = doctors.select(F.col("id").alias("doctor_id"), "headquarter_id").where("headquarter_id is not null")
    wanted = allocations.join(of, "doctor_id").select("mr_id", "headquarter_id", F.lit(caller).alias("allocated_by"), F.lit(True).alias("is_active")).distinct()
    return insert_ignore(existing, wanted, ["mr_id", "headquarter_id"], F.col("is_active"))
