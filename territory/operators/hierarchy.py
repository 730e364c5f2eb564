"""The manager tree: subtrees, reporting chains, snapshots and what a caller may see.

Users are (id, full_name, role, reports_to, is_active, ...). Walks down need active users all the way; walks
up don't. All users' walks double their pointers (see doubling); a cycle raises and is named. One user's chain is a recursive
query of as many rows as it has levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.operators.doubling import fold, pairs

#: Fixed role names.
MR, ASM, RSM, DEPUTY_RSM, STATE_HEAD, SALES_DIRECTOR, SUPER_ADMIN = "MR", "ASM", "RSM", "DEPUTY_RSM", "STATE_HEAD", "SALES_DIRECTOR", "SUPER_ADMIN"
EVERYTHING = (SUPER_ADMIN, SALES_DIRECTOR)
SUBTREE = (STATE_HEAD, RSM, DEPUTY_RSM, ASM)


def _active(users: DataFrame) -> DataFrame:
    """(id, up, role, full_name) of active users."""
    return users.where("is_active").select("id", F.col("reports_to").alias("up"), "role", "full_name")


def closure(users: DataFrame) -> DataFrame:
    """(root_id, id, role, full_name, depth): each active user with all active users below, itself included."""
    active = _active(users)
    found = pairs(active.select("id", "up")).withColumnRenamed("above_id", "root_id")
    return found.join(active.drop("up"), "id").select("root_id", "id", "role", "full_name", "depth")


def below(users: DataFrame, root: str) -> DataFrame:
    """(id, depth, via) of the active subtree of one active user: how far each is below, and by which direct report (null for the root).

    Ways that miss the root are dropped as soon as they end, and those that run in a cycle elsewhere don't matter.
    """
    at = F.col("id") == root
    direct = F.col("reports_to") == root
    nodes = users.where("is_active").select(
        "id",
        F.when(~at, F.col("reports_to")).alias("up"),
        F.lit(1).alias("steps"),
        F.when(at, 0).alias("depth"),
        F.when(direct & ~at, F.col("id")).alias("via"),
    )
    combine = {
        "up": lambda own, above: F.when(own("depth").isNull() & above("depth").isNull(), above("up")),
        "steps": lambda own, above: own("steps") + F.coalesce(above("steps"), F.lit(0)),
        "depth": lambda own, above: F.coalesce(own("depth"), own("steps") + above("depth")),
        "via": lambda own, above: F.coalesce(own("via"), above("via")),
    }
    found = fold(nodes, combine, F.col("depth").isNotNull() | F.col("up").isNotNull(), cycles="stop")
    return found.where("depth is not null").select("id", "depth", F.when(F.col("depth") > 0, F.col("via")).alias("via"))


def subtree(users: DataFrame, root: str) -> DataFrame:
    """(id, full_name, role, reports_to, depth) of the active subtree of one active user."""
    return below(users, root).drop("via").join(users.select("id", "full_name", "role", "reports_to"), "id").select("id", "full_name", "role", "reports_to", "depth")


def by_depth(users: DataFrame, root: str) -> DataFrame:
    """The subtree from the top down: by depth, then name, then id."""
    return subtree(users, root).orderBy("depth", "full_name", "id")


def subtree_mrs(users: DataFrame, root: str) -> DataFrame:
    """(mr_id) of the active reps under a manager, who counts if a rep."""
    return subtree(users, root).where(F.col("role") == MR).select(F.col("id").alias("mr_id"))


def chains(users: DataFrame) -> DataFrame:
    """(user_id, id, full_name, role, is_active, depth): each user with all managers up to the top, inactive ones too."""
    found = pairs(users.select("id", F.col("reports_to").alias("up"))).withColumnsRenamed({"id": "user_id", "above_id": "id"})
    return found.join(users.select("id", "full_name", "role", "is_active"), "id").select("user_id", "id", "full_name", "role", "is_active", "depth")


def reporting_chain(users: DataFrame, user: str) -> DataFrame:
    """(id, full_name, role, is_active, depth) from a user up to the top."""
    query = """
        WITH RECURSIVE above(id, full_name, role, reports_to, is_active, depth) AS (
            SELECT id, full_name, role, reports_to, is_active, 0 FROM {users} WHERE id = {user}
            UNION ALL
            SELECT u.id, u.full_name, u.role, u.reports_to, u.is_active, a.depth + 1 FROM above a JOIN {users} u ON u.id = a.reports_to)
        SELECT id, full_name, role, is_active, depth FROM above"""
    return users.sparkSession.sql(query, users=users, user=user)


def manager_snapshot(users: DataFrame) -> DataFrame:
    """(mr_id, asm_id, rsm_id, state_head_id): for each rep the nearest manager of each role; a deputy counts as RSM."""
    kinds = {"asm_id": (ASM,), "rsm_id": (RSM, DEPUTY_RSM), "state_head_id": (STATE_HEAD,)}
    own = [F.when(F.col("role").isin(*roles), F.col("id")).alias(c) for c, roles in kinds.items()]
    nodes = users.select("id", F.col("reports_to").alias("up"), (F.col("role") == MR).alias("is_rep"), *own)
    found = fold(nodes, {c: lambda own, above, c=c: F.coalesce(own(c), above(c)) for c in kinds})
    return found.where("is_rep").select(F.col("id").alias("mr_id"), *kinds)


def role_of(users: DataFrame, user: str) -> str | None:
    row = users.where(F.col("id") == user).select("role").first()
    return row.role if row else None


def visible_mrs(users: DataFrame, caller: str) -> DataFrame:
    """(mr_id) that a caller may see: a rep itself, even if inactive; admins all active reps; managers their subtree's."""
    role = role_of(users, caller)
    if role == MR:
        return users.where(F.col("id") == caller).select(F.col("id").alias("mr_id"))
    if role in EVERYTHING:
        return users.where((F.col("role") == MR) & F.col("is_active")).select(F.col("id").alias("mr_id"))
    if role in SUBTREE:
        return subtree_mrs(users, caller)
    return users.limit(0).select(F.col("id").alias("mr_id"))


def resolve_scope(users: DataFrame, caller: str, scope: str | None = None) -> str:
    """The user whose data a caller looks at: itself by default; admins anyone; others someone in their subtree."""
    if scope is None or scope == caller:
        return caller
    if role_of(users, scope) is None:
        raise ValueError(f"no user {scope}")
    if role_of(users, caller) in EVERYTHING:
        return scope
    if subtree(users, caller).where(F.col("id") == scope).isEmpty():
        raise PermissionError(f"{scope} is outside the subtree of {caller}")
    return scope


def resolve_mr(users: DataFrame, caller: str, mr: str | None) -> DataFrame:
    """Visible reps, narrowed to one that must be visible."""
    seen = visible_mrs(users, caller)
    if mr is None:
        return seen
    one = seen.where(F.col("mr_id") == mr)
    if one.isEmpty():
        raise PermissionError(f"{mr} isn't visible to {caller}")
    return one


def team(users: DataFrame, scope: str) -> DataFrame:
    """Direct active reports of a user by name, with the number of direct reports and of reps below; a rep counts itself."""
    code = ["employee_code"] if "employee_code" in users.columns else []
    reports = users.where((F.col("reports_to") == scope) & F.col("is_active"))
    direct = users.where("is_active").groupBy(F.col("reports_to").alias("id")).agg(F.count("*").alias("direct_report_count"))
    under = below(users.withColumn("is_active", F.col("is_active") | (F.col("id") == scope)), scope)
    reps = under.join(users.where(F.col("role") == MR).select("id"), "id", "left_semi").groupBy(F.col("via").alias("id")).agg(F.count("*").alias("mr_descendant_count"))
    found = reports.join(direct, "id", "left").join(reps, "id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("direct_report_count", "mr_descendant_count")]
    return found.select("id", "full_name", "role", *code, *counts).orderBy("full_name", "id")


def breadcrumb(users: DataFrame, caller: str, scope: str) -> DataFrame:
    """The chain from caller down to scope; the whole chain if the caller isn't in it."""
    up = reporting_chain(users, scope)
    at = up.where(F.col("id") == caller).select("depth").first()
    return (up.where(F.col("depth") <= at.depth) if at else up).select("id", "full_name", "role", "depth").orderBy(F.desc("depth"))


def direct_reports(users: DataFrame, manager: str) -> DataFrame:
    return users.where((F.col("reports_to") == manager) & F.col("is_active"))


def directory(users: DataFrame, caller: str) -> DataFrame:
    """Users that a caller may list: the super admin all, other managers their active subtree, a rep none."""
    role = role_of(users, caller)
    if role == MR or role is None:
        raise PermissionError(f"{caller} may not list users")
    return users if role == SUPER_ADMIN else users.join(subtree(users, caller).select("id"), "id", "left_semi")


def mrs_of_state(users: DataFrame, state: str) -> DataFrame:
    return users.where((F.col("role") == MR) & F.col("is_active") & (F.col("state_id") == state)).select(F.col("id").alias("mr_id"))
