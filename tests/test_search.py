"""Search by runs finds what ILIKE finds, and reads candidates only."""

import pytest
from pyspark.sql import functions as F

from territory.operators import lookup, search
from territory.operators import sales_import as imp
from territory.operators.predicates import search as scan

TEXTS = ["Amoxil 500", "AMOXIL Forte", "zinc 100% pure", "a_b_c", "Élan Vital", "straße", "ab", "", None, "back\\slash", "xamoxilx", "moxi", "zinc_100"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("search")
    rows = [(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)]
    table = lookup.write_sorted(spark.createDataFrame(rows, "id long, name string, other string"), str(folder / "t"), "id")
    return table, search.write_postings(table, str(folder / "p"), "name", "other")


@pytest.mark.parametrize("q", ["amoxil", " MOXI ", "zinc%pure", "a_b_c", "zinc_100", "100\\%", "élan", "STRASSE", "ab", "", None, "%", "_", "k\\\\s", "nothing here", "amo%rte", "o___l", "amoxil forte amoxil forte"])
def test_same_as_ilike(indexed, q):
    table, postings = indexed
    assert sorted(r.id for r in search.search_indexed(table, postings, q, "name", "other").collect()) == sorted(r.id for r in scan(table, q, "name", "other").collect())


def test_candidates_only(spark, tmp_path):
    rows = spark.range(100_000).select("id", F.concat(F.lit("name "), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    table = lookup.write_sorted(rows, str(tmp_path / "t"), "id", files=2, row_group_bytes=1 << 20)
    postings = search.write_postings(table, str(tmp_path / "p"), "name")
    asked = rows.where("id = 777").first().name[20:40]
    found = search.search_indexed(table, postings, asked, "name")
    assert [r.id for r in found.collect()] == [777] and lookup.rows_scanned(found) < 30_000


def test_rows_of_any_columns_in_one_table(spark):
    rows = spark.createDataFrame([(1, 2.5, None, ["x"]), (2, None, "b", None)], "row_index int, q double, t string, errors array<string>")
    packed = imp.structured(rows, "row_index").unionByName(imp.structured(spark.createDataFrame([(3, "many")], "row_index int, q string"), "row_index"))
    back = imp.unstructured(packed, "q double, t string, errors array<string>, other int", "row_index")
    assert sorted(map(tuple, back.collect())) == [(1, 2.5, None, ["x"], None), (2, None, "b", None, None), (3, None, None, None, None)]
