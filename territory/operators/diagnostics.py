"""Questions about allocations that explain what an import did, and maintenance of old tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_doctors(mr_doctors: DataFrame) -> DataFrame:
    """(doctor_id, n_mrs, inactive): doctors whom several reps have."""
    return mr_doctors.groupBy("doctor_id").agg(F.countDistinct("mr_id").alias("n_mrs"), F.count_if(~F.col("is_active")).alias("inactive")).where("n_mrs > 1")


def without_allocation(users: DataFrame, mr_doctors: DataFrame) -> DataFrame:
    """(mr_id) of active reps without an active allocation."""
    reps = users.where("role = 'MR' and is_active").select(F.col("id").alias("mr_id"))
    return reps.join(mr_doctors.where("is_active").select("mr_id"), "mr_id", "left_anti")


def serving_headquarters(products: DataFrame, headquarters: DataFrame) -> DataFrame:
    """(product_id, headquarter_id): for each product the least active headquarter that serves its division."""
    served = headquarters.where("is_active").select(F.col("id").alias("headquarter_id"), F.explode("division_ids").alias("division_id"))
    first = served.groupBy("division_id").agg(F.min("headquarter_id").alias("headquarter_id"))
    return products.join(first, "division_id").select(F.col("id").alias("product_id"), "headquarter_id")


def allocation_bundle(allocations: DataFrame, dimension: DataFrame, key: str, label: str) -> DataFrame:
    """Allocations with the name of what is allocated, the latest first, inactive ones too."""
    names = dimension.select(F.col("id").alias(key), F.col(label).alias("name"))
    return allocations.join(names, key, "left").orderBy(F.desc("allocated_at"), key)


def to_array(df: DataFrame, scalar: str, array: str) -> DataFrame:
    """A column of one value as a column of lists; null gives an empty list."""
    return df.withColumn(array, F.array_compact(F.array(scalar))).drop(scalar)


def to_scalar(df: DataFrame, array: str, scalar: str) -> DataFrame:
    """The first of each list; null for an empty one."""
    return df.withColumn(scalar, F.get(array, F.lit(0))).drop(array)


def scorecard(texts: DataFrame) -> DataFrame:
    """(path, n_chars, empty, sheets) of extracted files: empty under 50 characters, and how many sheets they had."""
    return texts.select("path", F.length("text").alias("n_chars"), (F.length(F.trim("text")) < 50).alias("empty"), (F.size(F.split("text", "### SHEET: ")) - 1).alias("sheets"))
