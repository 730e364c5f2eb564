"""Report queries: summary, time series and shares by dimension or manager."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territory.functions import windows as w
from territory.operators import hierarchy as h
from territory.operators.dashboard import Filters, money, quantity, total
from territory.operators.predicates import REPORT_KEYS, sales_predicate, scoped

#: Dimensions of shares; hq is another name of headquarter.
PIES = ("product", "location", "headquarter", "division", "rsm", "asm")


def chosen(sales: DataFrame, mrs: DataFrame, start: date, end: date, filters: Filters = None) -> DataFrame:
    w.check_range(start, end, w.LONGEST_REPORT)
    return scoped(sales, mrs, sales_predicate(start, end, filters, REPORT_KEYS))


def pie_names(text: str | None) -> list[str]:
    """Dimension names from a comma list, each once, in order."""
    out: list[str] = []
    for name in (text or "").lower().split(","):
        name = {"hq": "headquarter"}.get(name.strip(), name.strip())
        if name and name not in PIES:
            raise ValueError(f"no dimension {name}")
        if name and name not in out:
            out.append(name)
    return out


def summary(rows: DataFrame, qty_mode: str = "reference") -> DataFrame:
    return rows.agg(F.count("*").alias("line_count"), quantity(total("sale_qty"), qty_mode).alias("total_sale_qty"), quantity(total("free_qty"), qty_mode).alias("total_free_qty"), money(total("total_amount")).alias("total_amount"))


def series(rows: DataFrame, bucket: str, qty_mode: str = "reference") -> DataFrame:
    """Sums of each day, week (from Monday) or month that has sales; another bucket counts as day."""
    day = F.col("sale_date").cast("timestamp")
    period = F.date_format(F.date_trunc(bucket if bucket in ("week", "month") else "day", day), "yyyy-MM-dd")
    sums = rows.groupBy(period.alias("period")).agg(money(total("total_amount")).alias("revenue"), quantity(total("sale_qty"), qty_mode).alias("sale_qty"), quantity(total("free_qty"), qty_mode).alias("free_qty"))
    return sums.orderBy("period")


def _shares(sums: DataFrame, name: str, qty: Column) -> DataFrame:
    """Shares of all rows; they have a row for each dimension value."""
    sums = sums.select(F.lit(name).alias("dimension"), "id", "label", money(F.col("r")).alias("revenue"), qty.alias("sale_qty"), money(F.col("r")).alias("r"), F.col("q").cast("double").alias("q"))
    whole = {c: sums.agg(F.sum(c)).scalar() for c in ("r", "q")}  # one row, added up in parts, not a window of all rows
    share = lambda c: F.when(whole[c] > 0, F.round(F.col(c) / whole[c] * 100, 6)).otherwise(F.lit(0.0))
    return sums.withColumns({"pct_revenue": share("r"), "pct_quantity": share("q")}).drop("r", "q").orderBy(F.desc("revenue"), "label", "id")


def pie(rows: DataFrame, name: str, dimension: DataFrame, label: str = "name", qty_mode: str = "reference") -> DataFrame:
    """Revenue and quantity of each value of a dimension with their shares; null and unknown keys drop out."""
    sums = rows.where(F.col(f"{name}_id").isNotNull()).groupBy(F.col(f"{name}_id").alias("id")).agg(total("total_amount").alias("r"), total("sale_qty").alias("q"))
    sums = sums.join(dimension.select("id", F.col(label).alias("label")), "id")
    if qty_mode == "reference":
        sums = sums.withColumn("q", F.col("q").cast("long"))
    return _shares(sums, name, quantity(F.col("q"), qty_mode))


def pie_by_manager(rows: DataFrame, users: DataFrame, role: str, qty_mode: str = "reference") -> DataFrame:
    """The same for every active manager of exactly this role, with the sales of the reps below; zero rows stay.

    Managers outside of the caller's scope are listed, with zeros; sales below two nested managers count for both.
    Quantities round to whole numbers in reference mode.
    """
    below = h.closure(users).where(F.col("role") == h.MR).select("root_id", F.col("id").alias("mr_id"))
    by_rep = rows.groupBy("mr_id").agg(F.sum("total_amount").alias("r"), F.sum("sale_qty").alias("q"))
    sums = by_rep.join(below, "mr_id").groupBy(F.col("root_id").alias("id")).agg(F.sum("r").alias("r"), F.sum("q").alias("q"))
    managers = users.where((F.col("role") == role) & F.col("is_active")).select("id", F.col("full_name").alias("label"))
    zero = F.lit(0)
    sums = managers.join(sums, "id", "left").withColumns({"r": F.coalesce("r", zero), "q": F.coalesce("q", zero)})
    if qty_mode == "reference":
        sums = sums.withColumn("q", F.round("q").cast("long"))
    return _shares(sums, role.lower(), quantity(F.col("q"), qty_mode))
