"""Substring search by runs of three characters: what can't hold a pattern isn't read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.operators import lookup
from territory.operators.predicates import search

#: Runs of a pattern that candidates must have; more would rule out few more.
RUNS = 10


def runs_of(pattern: str) -> list[str]:
    """Runs of three characters, in lower case, that every text has which a LIKE pattern with % around it fits; evenly picked if there are many."""
    pieces, piece, escaped = [], "", False
    for c in pattern.strip().lower():
        if not escaped and c in "%_":
            pieces.append(piece)
            piece = ""
        elif not escaped and c == "\\":
            escaped = True
            continue
        else:
            piece += c
        escaped = False
    found = list(dict.fromkeys(p[i : i + 3] for p in [*pieces, piece] for i in range(len(p) - 2)))
    return found if len(found) <= RUNS else [found[i * len(found) // RUNS] for i in range(RUNS)]


def write_postings(df: DataFrame, path: str, *columns: str, id: str = "id") -> DataFrame:
    """(run, at, id): the runs of each text column of a table, sorted by run; `at` is the column."""
    texts = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lower(F.col(c)).alias("text")) for i, c in enumerate(columns)]))
    rows = df.select(F.col(id).alias("id"), texts.alias("t")).where(F.length("t.text") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t.text") - 2), lambda i: F.substring(F.col("t.text"), i, F.lit(3))))
    return lookup.write_sorted(rows.select(F.explode(grams).alias("run"), "t.at", "id"), path, "run")


def search_indexed(table: DataFrame, postings: DataFrame, q: str | None, *columns: str, id: str = "id") -> DataFrame:
    """What `search` finds in a table whose postings were written for the same columns.

    Rows that have all runs of the pattern in one column are candidates; only these are read and checked. A pattern without three
    characters in a row is looked for in all rows.
    """
    runs = runs_of(q or "")
    if not runs:
        return search(table, q, *columns)
    met = postings.where(F.col("run").isin(runs)).groupBy("id", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(runs))
    return search(lookup.by_keys(table, met.select("id"), id), q, *columns)
