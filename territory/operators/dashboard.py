"""Dashboard queries: totals, overview, trends, top lists, growth, filters and export.

`sales` are all sales, `mrs` the reps in scope. Quantities are exact decimals; with qty_mode="reference" sums are
cut to whole numbers. Money turns into double at the output only. Ties in rankings go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territory.functions import windows as w
from territory.operators.predicates import sales_predicate, scoped

Filters = Mapping[str, str | None] | None


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def money(column: Column) -> Column:
    return column.cast("double")


def quantity(column: Column, qty_mode: str = "exact") -> Column:
    return column.cast("long" if qty_mode == "reference" else "double")


def kpi_totals(sales: DataFrame, mrs: DataFrame, start: date | None, end: date | None, filters: Filters = None, qty_mode: str = "reference") -> DataFrame:
    """One row (revenue, sale_qty, line_count), zeros for an empty scope."""
    rows = scoped(sales, mrs, sales_predicate(start, end, filters))
    return rows.agg(money(total("total_amount")).alias("revenue"), quantity(total("sale_qty"), qty_mode).alias("sale_qty"), F.count("*").alias("line_count"))


def overview(sales: DataFrame, mrs: DataFrame, today: date, start: date | None = None, end: date | None = None, filters: Filters = None, qty_mode: str = "reference") -> DataFrame:
    """A row for each block (selected, yearly, quarterly, monthly) with its window's totals and change in percent.

    All windows and the ones they are compared with come from one scan. The calendar windows are anchored at
    `end`, else today. The change is null unless the earlier revenue is positive.
    """
    if (start is None) != (end is None):
        raise ValueError("give both days or none")
    w.check_range(start, end)
    anchor = end or today
    spans = ([("selected", (start, end))] if start else []) + [(f"{unit}ly", w.window(anchor, unit)) for unit in ("year", "quarter", "month")]
    modes = {"selected": None, "yearly": "yoy", "quarterly": "qoq", "monthly": "mom"}
    blocks, sums = [], []

    def inside(span: w.Window) -> Column:
        return F.col("sale_date").between(F.lit(span[0]), F.lit(span[1]))

    for i, (name, span) in enumerate(spans):
        label, mode = w.described(span)
        before = w.previous(span, modes[name] or mode)
        blocks.append((i, name, label, span, before))
        sums += [F.coalesce(F.sum(F.when(inside(span), F.col(c))), F.lit(0)).alias(f"{c}{i}") for c in ("total_amount", "sale_qty")]
        sums += [F.count(F.when(inside(span), 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(inside(before), F.col("total_amount"))), F.lit(0)).alias(f"before{i}")]
    first, last = min(b[4][0] for b in blocks), max(b[3][1] for b in blocks)
    row = scoped(sales, mrs, sales_predicate(first, last, filters)).agg(*sums)
    out = []
    for i, name, label, span, _ in blocks:
        now, was = money(F.col(f"total_amount{i}")), money(F.col(f"before{i}"))
        out.append(
            F.struct(
                F.lit(i + 1).alias("block_no"), F.lit(name).alias("block"), F.lit(label).alias("label"), F.lit(str(span[0])).alias("date_from"), F.lit(str(span[1])).alias("date_to"), now.alias("revenue"),
                quantity(F.col(f"sale_qty{i}"), qty_mode).alias("sale_qty"), F.col(f"n{i}").alias("line_count"), F.when(was > 0, F.round((now - was) / was * 100, 2)).alias("delta_pct"),
            )
        )
    return row.select(F.inline(F.array(*out)))


def trend(sales: DataFrame, mrs: DataFrame, bucket: str, start: date | None, end: date | None, filters: Filters = None, qty_mode: str = "reference") -> DataFrame:
    """Revenue and quantity of each month, quarter or year that has sales, in order."""
    if bucket not in w.MONTHS_IN:
        raise ValueError(f"no bucket {bucket}")
    w.check_range(start, end)
    rows = scoped(sales, mrs, sales_predicate(start, end, filters)).groupBy(F.date_trunc(bucket, F.col("sale_date").cast("timestamp")).alias("b")).agg(total("total_amount").alias("r"), total("sale_qty").alias("q"))
    return rows.select(F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("period_key"), w.bucket_label(F.col("b"), bucket).alias("label"), money(F.col("r")).alias("revenue"), quantity(F.col("q"), qty_mode).alias("sale_qty")).orderBy("period_key")


def top_list(sales: DataFrame, mrs: DataFrame, key: str, dimension: DataFrame, label: str, start: date | None, end: date | None, limit: int = 20, filters: Filters = None, qty_mode: str = "reference") -> DataFrame:
    """(id, label, revenue, sale_qty, pct_revenue): the dimension values with most revenue; shares are of the rows returned.

    Sums come before the join with labels; rows without a key or without a label drop out.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    rows = scoped(sales, mrs, sales_predicate(start, end, filters) & F.col(key).isNotNull())
    sums = rows.groupBy(F.col(key).alias("id")).agg(total("total_amount").alias("r"), total("sale_qty").alias("q"))
    best = sums.join(dimension.select("id", F.col(label).alias("label")), "id").orderBy(F.desc("r"), "id").limit(limit)
    revenue = money(F.col("r"))
    whole = F.sum(revenue).over(Window.partitionBy())  # over at most `limit` rows
    return best.select("id", "label", revenue.alias("revenue"), quantity(F.col("q"), qty_mode).alias("sale_qty"), F.when(whole > 0, F.round(revenue / whole * 100, 4)).otherwise(F.lit(0.0)).alias("pct_revenue")).orderBy(F.desc("revenue"), "id")


def product_growth(sales: DataFrame, mrs: DataFrame, products: DataFrame, reference: date, mode: str, limit: int = 10, filters: Filters = None) -> DataFrame:
    """Growing and degrowing products between the window of a day and the one before it, a rank in each list.

    New products lead the growers by revenue. The percentage is null unless the earlier revenue is positive;
    among degrowers a null counts as -100.
    """
    if mode not in ("mom", "qoq", "yoy") or not 1 <= limit <= 50:
        raise ValueError("mode is mom, qoq or yoy, limit 1 to 50")
    span = w.window(reference, {"mom": "month", "qoq": "quarter", "yoy": "year"}[mode])
    before = w.previous(span, mode)
    rows = scoped(sales, mrs, sales_predicate(before[0], span[1], filters))

    def within(s: w.Window) -> Column:
        return F.when(F.col("sale_date").between(F.lit(s[0]), F.lit(s[1])), F.col("total_amount"))

    sums = rows.groupBy("product_id").agg(money(F.coalesce(F.sum(within(span)), F.lit(0))).alias("current_revenue"), money(F.coalesce(F.sum(within(before)), F.lit(0))).alias("previous_revenue"))
    sums = sums.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id")
    change = F.col("current_revenue") - F.col("previous_revenue")
    sums = sums.withColumns({"delta_abs": F.round(change, 2), "delta_pct": F.when(F.col("previous_revenue") > 0, F.round(change / F.col("previous_revenue") * 100, 2))})
    fresh = (F.col("previous_revenue") <= 0) & (F.col("current_revenue") > 0)
    up = sums.where(F.col("delta_abs") > 0).withColumns({"list": F.lit("growing"), "key1": F.when(fresh, 0).otherwise(1), "key2": -F.when(fresh, F.col("current_revenue")).otherwise(F.coalesce("delta_pct", F.lit(0.0)))})
    down = sums.where(F.col("delta_abs") < 0).withColumns({"list": F.lit("degrowing"), "key1": F.lit(0), "key2": F.coalesce("delta_pct", F.lit(-100.0))})
    order = ("key1", "key2", "product_id")
    best = [x.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(*order))) for x in (up, down)]
    return best[0].unionByName(best[1]).select("list", "rank", "product_id", "product_name", "current_revenue", "previous_revenue", "delta_abs", "delta_pct")


def filter_sources(sales: DataFrame, mrs: DataFrame, start: date | None, end: date | None, keys: tuple[str, ...] = ("product_id", "doctor_id", "medical_store_id", "headquarter_id", "division_id", "state_id")) -> DataFrame:
    """(dimension, id): the values of each dimension that occur, from one scan."""
    rows = scoped(sales, mrs, sales_predicate(start, end))
    pairs = F.explode(F.array(*[F.struct(F.lit(k.removesuffix("_id")).alias("dimension"), F.col(k).alias("id")) for k in keys]))
    return rows.select(pairs.alias("x")).select("x.*").where("id is not null").distinct()


def filter_labels(found: DataFrame, labels: dict[str, DataFrame]) -> DataFrame:
    """(dimension, id, label, sublabel) of (dimension, id): `labels` has (id, label, sublabel) for each dimension; ids without one go."""
    out = None
    for name, rows in labels.items():
        part = found.where(F.col("dimension") == name).join(rows.select("id", "label", "sublabel"), "id").select("dimension", "id", "label", "sublabel")
        out = part if out is None else out.unionByName(part)
    return out


def ranked_export(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, rank, label, revenue): top lists under one another, revenue with two decimals."""
    out = None
    for name, rows in sections.items():
        rank = F.row_number().over(Window.orderBy(F.desc("revenue"), "id"))  # over a top list
        part = rows.select(F.lit(name).alias("section"), rank.alias("rank"), "label", F.format_string("%.2f", "revenue").alias("revenue"))
        out = part if out is None else out.unionByName(part)
    return out
