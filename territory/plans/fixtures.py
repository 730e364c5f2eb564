"""The business tables as views over the star schema that the checks supply, for Spark and as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Business:
    """Users, sales, dimensions and bridges, each read when it is asked for."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        region, nation, supplier = self.table("region"), self.table("nation"), self.table("supplier")
        columns = ("id", "full_name", "role", "reports_to", "is_active")

        def rows(df: DataFrame, *values) -> DataFrame:
            return df.select(*(v.alias(c) for v, c in zip(values, columns, strict=True)))

        text = lambda c: F.col(c).cast("string")
        top = rows(region.where("r_regionkey = 0"), F.lit("SD"), F.lit("Sales Director"), F.lit("SALES_DIRECTOR"), F.lit(None).cast("string"), F.lit(True))
        heads = rows(region, F.concat(F.lit("SH-"), text("r_regionkey")), F.col("r_name"), F.lit("STATE_HEAD"), F.lit("SD"), F.lit(True))
        regional = rows(nation, F.concat(F.lit("RS-"), text("n_nationkey")), F.col("n_name"), F.lit("RSM"), F.concat(F.lit("SH-"), text("n_regionkey")), F.col("n_nationkey") != 24)
        areas = nation.withColumn("half", F.explode(F.array(F.lit("0"), F.lit("1"))))
        areas = rows(areas, F.concat(F.lit("AS-"), text("n_nationkey"), F.lit("-"), F.col("half")), F.concat("n_name", F.lit(" "), "half"), F.lit("ASM"), F.concat(F.lit("RS-"), text("n_nationkey")), F.lit(True))
        area_id = F.concat(F.lit("AS-"), text("s_nationkey"), F.lit("-"), (F.col("s_suppkey") % 2).cast("string"))
        reps = rows(supplier, F.concat(F.lit("MR-"), text("s_suppkey")), F.col("s_name"), F.lit("MR"), area_id, F.col("s_acctbal") > 0)
        return top.unionByName(heads).unionByName(regional).unionByName(areas).unionByName(reps)

    @cached_property
    def sales(self) -> DataFrame:
        lines = self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        lines = lines.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        lines = lines.join(self.table("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        lines = lines.join(self.table("part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        number = F.col("l_linenumber")
        lines = lines.select(
            F.concat(F.lit("MR-"), F.col("l_suppkey").cast("string")).alias("mr_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("o_custkey").cast("string").alias("medical_store_id"),
            F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 50).cast("string")).alias("doctor_id"),
            F.col("p_brand").alias("division_id"),
            F.col("s_nationkey").cast("string").alias("headquarter_id"),
            F.when(number <= 3, (F.col("s_nationkey") * 10 + number).cast("string")).alias("location_id"),
            F.col("n_regionkey").cast("string").alias("state_id"),
            F.col("l_shipdate").cast("date").alias("sale_date"),
            (F.col("l_quantity") / 4).cast("decimal(12,2)").alias("sale_qty"),
            (F.col("l_tax") * 100).cast("decimal(12,2)").alias("free_qty"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("ptr"),
            F.when(number % 3 == 0, (F.col("p_retailprice") - 10).cast("decimal(10,2)")).alias("special_price"),
            (F.col("l_returnflag") != "R").alias("is_active"),
            F.when(number % 5 != 0, F.concat(F.lit("AS-"), F.col("s_nationkey").cast("string"), F.lit("-"), (F.col("l_suppkey") % 2).cast("string"))).alias("asm_id"),
            F.concat(F.lit("RS-"), F.col("s_nationkey").cast("string")).alias("rsm_id"),
            F.concat(F.lit("SH-"), F.col("n_regionkey").cast("string")).alias("state_head_id"),
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), number.cast("string")).alias("id"),
            F.when(number % 2 == 0, (F.col("p_retailprice") - 5).cast("decimal(10,2)")).alias("pts"),
            (F.col("p_retailprice") + 20).cast("decimal(10,2)").alias("mrp"),
            F.when(number == 1, (F.col("l_quantity") * 10).cast("decimal(12,2)")).alias("reported_amount"),
            F.concat(F.lit("B"), F.col("l_orderkey").cast("string")).alias("bill_ref"),
            F.concat(F.lit("L"), number.cast("string")).alias("batch"),
            F.lit(None).cast("string").alias("pack"),
            F.lit(None).cast("string").alias("remarks"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_shipdate").alias("updated_at"),
        )
        return with_total(lines)

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("division_id"), F.col("p_retailprice").cast("decimal(10,2)").alias("ptr"), F.lit(True).alias("is_active"))

    @cached_property
    def headquarters(self) -> DataFrame:
        sold = self.sales.groupBy("headquarter_id").agg(F.array_sort(F.collect_set("division_id")).alias("division_ids"))
        nation = self.table("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("state_id"), F.lit(True).alias("is_active"))
        return nation.join(sold, F.col("id") == F.col("headquarter_id"), "left").drop("headquarter_id")

    @cached_property
    def stores(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("headquarter_id"), F.lit(True).alias("is_active"))

    @cached_property
    def doctors(self) -> DataFrame:
        ids = self.table("customer").where("c_custkey % 7 <> 0").select((F.col("c_custkey") % 50).cast("string").alias("id")).distinct()
        return ids.select("id", F.concat(F.lit("Doctor "), "id").alias("full_name"), F.lit(True).alias("is_active"))

    @cached_property
    def store_doctors(self) -> DataFrame:
        store = self.table("customer").select("c_custkey")
        own = store.where("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("string").alias("medical_store_id"), (F.col("c_custkey") % 50).cast("string").alias("doctor_id"))
        more = store.where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("medical_store_id"), ((F.col("c_custkey") + 1) % 50).cast("string").alias("doctor_id"))
        return own.unionByName(more).distinct()

    @cached_property
    def mr_doctors(self) -> DataFrame:
        chosen = self.table("supplier").where("(s_suppkey < 50 OR s_suppkey % 5 = 0) AND (s_suppkey % 50) % 11 <> 3")
        return chosen.select(F.concat(F.lit("MR-"), F.col("s_suppkey").cast("string")).alias("mr_id"), (F.col("s_suppkey") % 50).cast("string").alias("doctor_id"), (F.col("s_suppkey") % 13 != 0).alias("is_active"))


def with_total(sales: DataFrame) -> DataFrame:
    """Add total_amount: quantity times the special price, or the trade price where there is none."""
    return sales.withColumn("total_amount", (F.col("sale_qty") * F.coalesce("special_price", "ptr")).cast("decimal(12,2)"))


USERS_SQL = """
v_users AS (
  SELECT 'SD' AS id, 'Sales Director' AS full_name, 'SALES_DIRECTOR' AS role, NULL::VARCHAR AS reports_to, true AS is_active
  UNION ALL SELECT 'SH-' || r_regionkey, r_name, 'STATE_HEAD', 'SD', true FROM region
  UNION ALL SELECT 'RS-' || n_nationkey, n_name, 'RSM', 'SH-' || n_regionkey, n_nationkey <> 24 FROM nation
  UNION ALL SELECT 'AS-' || n_nationkey || '-' || i, n_name || ' ' || i, 'ASM', 'RS-' || n_nationkey, true FROM nation, (VALUES ('0'), ('1')) t(i)
  UNION ALL SELECT 'MR-' || s_suppkey, s_name, 'MR', 'AS-' || s_nationkey || '-' || (s_suppkey % 2), s_acctbal > 0 FROM supplier),
below AS (
  SELECT id AS root_id, id, role, full_name, 0 AS depth FROM v_users WHERE is_active
  UNION ALL SELECT b.root_id, u.id, u.role, u.full_name, b.depth + 1 FROM below b JOIN v_users u ON u.reports_to = b.id WHERE u.is_active),
above AS (
  SELECT id AS user_id, id, role, full_name, reports_to, is_active, 0 AS depth FROM v_users
  UNION ALL SELECT a.user_id, u.id, u.role, u.full_name, u.reports_to, u.is_active, a.depth + 1 FROM above a JOIN v_users u ON u.id = a.reports_to)"""

SALES_SQL = """
v_lines AS (
  SELECT 'MR-' || l_suppkey AS mr_id, l_partkey::VARCHAR AS product_id, o_custkey::VARCHAR AS medical_store_id,
    CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 50)::VARCHAR END AS doctor_id, p_brand AS division_id, s_nationkey::VARCHAR AS headquarter_id,
    CASE WHEN l_linenumber <= 3 THEN (s_nationkey * 10 + l_linenumber)::VARCHAR END AS location_id, n_regionkey::VARCHAR AS state_id,
    l_shipdate::DATE AS sale_date, (l_quantity / 4)::DECIMAL(12,2) AS sale_qty, (l_tax * 100)::DECIMAL(12,2) AS free_qty,
    p_retailprice::DECIMAL(10,2) AS ptr, CASE WHEN l_linenumber % 3 = 0 THEN (p_retailprice - 10)::DECIMAL(10,2) END AS special_price,
    l_returnflag <> 'R' AS is_active, CASE WHEN l_linenumber % 5 <> 0 THEN 'AS-' || s_nationkey || '-' || (l_suppkey % 2) END AS asm_id,
    'RS-' || s_nationkey AS rsm_id, 'SH-' || n_regionkey AS state_head_id, l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN (p_retailprice - 5)::DECIMAL(10,2) END AS pts,
    (p_retailprice + 20)::DECIMAL(10,2) AS mrp, CASE WHEN l_linenumber = 1 THEN (l_quantity * 10)::DECIMAL(12,2) END AS reported_amount, 'B' || l_orderkey AS bill_ref, 'L' || l_linenumber AS batch,
    NULL::VARCHAR AS pack, NULL::VARCHAR AS remarks, l_shipdate AS created_at, l_shipdate AS updated_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
v_sales AS (SELECT *, (sale_qty * coalesce(special_price, ptr))::DECIMAL(12,2) AS total_amount FROM v_lines)"""

BRIDGES_SQL = """
v_store_doctor AS (
  SELECT c_custkey::VARCHAR AS medical_store_id, (c_custkey % 50)::VARCHAR AS doctor_id FROM customer WHERE c_custkey % 7 <> 0
  UNION SELECT c_custkey::VARCHAR, ((c_custkey + 1) % 50)::VARCHAR FROM customer WHERE c_custkey % 4 = 0),
v_mr_doctor AS (
  SELECT 'MR-' || s_suppkey AS mr_id, (s_suppkey % 50)::VARCHAR AS doctor_id, s_suppkey % 13 <> 0 AS is_active
  FROM supplier WHERE (s_suppkey < 50 OR s_suppkey % 5 = 0) AND (s_suppkey % 50) % 11 <> 3)"""

SQL_PREFIX = f"WITH RECURSIVE {USERS_SQL},{SALES_SQL},{BRIDGES_SQL}"
