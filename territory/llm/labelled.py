"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.base import crc_remainder

#: Labelled rows that a classifier is fitted on, at most; a classifier's own parameter.
FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int = 4, held: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """(id, text, y) of at most `rows` labelled documents outside the held-out fold, in the order of a hash of the id.

    `docs` has id and text. A document with several labels has the largest; null ids, texts and labels are left out.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), modulus) != held))
    y = y.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(rows)
    # the limit bounds what is broadcast
    return docs.where("id is not null and text is not null").join(F.broadcast(y), "id").select("id", "text", "y")
