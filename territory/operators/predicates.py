"""One builder for the filters that all sales queries share."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territory.operators import hierarchy as h

DASHBOARD_KEYS = ("product_id", "doctor_id", "medical_store_id", "headquarter_id", "division_id", "state_id")
REPORT_KEYS = ("product_id", "doctor_id", "headquarter_id", "location_id", "division_id", "state_id")


def sales_predicate(start: date | None = None, end: date | None = None, filters: Mapping[str, str | None] | None = None, keys: tuple[str, ...] = DASHBOARD_KEYS) -> Column:
    """Active sales between two days, both included, that equal every filter which is given."""
    found = F.col("is_active")
    if start:
        found &= F.col("sale_date") >= F.lit(start)
    if end:
        found &= F.col("sale_date") <= F.lit(end)
    for key, value in (filters or {}).items():
        if key not in keys:
            raise ValueError(f"no filter {key}")
        if value is not None:
            found &= F.col(key) == value
    return found


def scoped(sales: DataFrame, mrs: DataFrame, predicate: Column) -> DataFrame:
    """Sales that pass, of the given reps; the predicate goes down to the scan, the reps are a semi-join."""
    return sales.where(predicate).join(mrs, "mr_id", "left_semi")


#: Where a sale notes the manager of the day of each role.
MANAGERS = {h.ASM: "asm_id", h.RSM: "rsm_id", h.DEPUTY_RSM: "rsm_id", h.STATE_HEAD: "state_head_id"}


def may_see(role: str | None, id: str, below: Column) -> Column:
    """Whether a user may see a sale: admins any, reps their own, managers those that note them, or of their subtree (`below`) where none is noted."""
    if role in h.EVERYTHING:
        return F.lit(True)
    if role == h.MR:
        return F.col("mr_id") == id
    if role not in MANAGERS:
        return F.lit(False)
    noted = F.col(MANAGERS[role])
    return F.coalesce((noted == id) | (noted.isNull() & below), F.lit(False))


def snapshot_scope(sales: DataFrame, users: DataFrame, caller: str) -> DataFrame:
    """Sales that a caller may list: by the manager written on the row, and where that is null by today's tree."""
    role = h.role_of(users, caller)
    if role not in MANAGERS:
        return sales.where(may_see(role, caller, F.lit(False)))
    below = h.subtree_mrs(users, caller).select(F.col("mr_id").alias("__mr"), F.lit(True).alias("__below"))
    live = sales.join(below, F.col("mr_id") == F.col("__mr"), "left")
    return live.where(may_see(role, caller, F.coalesce("__below", F.lit(False)))).drop("__mr", "__below")


def search(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Rows where any column contains the text, in any case; % and _ in it are wildcards, a blank text finds all."""
    if not q or not q.strip():
        return df
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).ilike(f"%{q.strip()}%"), F.lit(False))
    return df.where(found)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    return df.offset((number - 1) * size).limit(size)


#: Columns of a listed sale, in order.
SALE_COLUMNS = (
    "id", "mr_id", "asm_id", "rsm_id", "state_head_id", "product_id", "doctor_id", "medical_store_id", "division_id", "headquarter_id", "location_id", "state_id", "sale_date", "sale_qty",
    "free_qty", "ptr", "pts", "mrp", "special_price", "total_amount", "reported_amount", "bill_ref", "batch", "pack", "remarks", "is_active", "created_at", "updated_at",
)


def sales_list(rows: DataFrame, number: int = 1, per_page: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a page of sales, (total) of all pages): the latest first, by date of sale, then of entry, then id; quantities and prices as doubles."""
    numbers = {f.name for f in rows.schema if f.dataType.typeName() == "decimal"}
    shown = [F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in SALE_COLUMNS]
    ordered = rows.select(*shown).orderBy(F.desc("sale_date"), F.desc("created_at"), "id")
    return page(ordered, number, per_page), rows.agg(F.count("*").alias("total"))


def envelope(listed: DataFrame, total: DataFrame, number: int, per_page: int) -> DataFrame:
    """(json) of one row: a page of a list, and how many rows and pages there are."""
    n = total.scalar()
    pages = F.ceil(n / per_page).cast("long")
    about = F.struct(F.lit(number).alias("page"), F.lit(per_page).alias("per_page"), n.alias("total"), pages.alias("total_pages"))
    data = listed.agg(F.collect_list(F.struct(*listed.columns)).alias("data"))  # a page is bounded
    return data.select(F.to_json(F.struct(F.lit(True).alias("success"), "data", F.lit("Operation successful").alias("message"), about.alias("pagination")), {"ignoreNullFields": "false"}).alias("json"))
