"""Hierarchies, windows, names, imports and ingestion on small invented tables."""

import difflib
import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from territory.functions import text as t
from territory.functions import windows as w
from territory.operators import entity_ingest as e
from territory.operators import hierarchy as h
from territory.operators import entity_ingest, matching, merge, predicates
from territory.operators import sales_import as imp
from territory.sources import sheets


@pytest.fixture(scope="module")
def users(spark):
    rows = [
        ("A", "Admin", "SUPER_ADMIN", None, True), ("H", "Head", "STATE_HEAD", "A", True), ("R", "Region", "RSM", "H", True), ("D", "Deputy", "DEPUTY_RSM", "R", True),
        ("S", "Area", "ASM", "D", True), ("X", "Closed", "ASM", "R", False), ("m1", "One", "MR", "S", True), ("m2", "Two", "MR", "X", True), ("m3", "Three", "MR", "S", False), ("m4", "Four", "MR", None, True),
    ]
    return spark.createDataFrame(rows, "id string, full_name string, role string, reports_to string, is_active boolean")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_inactive_manager_cuts_the_subtree(users):
    assert ids(h.visible_mrs(users, "R")) == ["m1"]
    assert ids(h.visible_mrs(users, "A")) == ["m1", "m2", "m4"]
    assert ids(h.visible_mrs(users, "m3")) == ["m3"]
    assert ids(h.visible_mrs(users, "nobody")) == []


def test_snapshot_takes_the_nearest_and_ignores_activity(users):
    found = {r.mr_id: (r.asm_id, r.rsm_id, r.state_head_id) for r in h.manager_snapshot(users).collect()}
    assert found["m1"] == ("S", "D", "H") and found["m2"] == ("X", "R", "H") and found["m4"] == (None, None, None)


def test_scope(users):
    assert h.resolve_scope(users, "R") == "R" and h.resolve_scope(users, "A", "m2") == "m2" and h.resolve_scope(users, "R", "S") == "S"
    with pytest.raises(PermissionError):
        h.resolve_scope(users, "R", "m2")
    with pytest.raises(ValueError):
        h.resolve_scope(users, "R", "nobody")


def test_cycle_raises(spark):
    loop = spark.createDataFrame([("a", "A", "ASM", "b", True), ("b", "B", "RSM", "a", True)], "id string, full_name string, role string, reports_to string, is_active boolean")
    with pytest.raises(Exception):
        h.closure(loop).collect()


def test_windows():
    assert w.window(date(2024, 2, 10), "quarter") == (date(2024, 1, 1), date(2024, 3, 31))
    assert w.previous((date(2024, 2, 1), date(2024, 2, 29)), "yoy") == (date(2023, 2, 1), date(2023, 2, 28))
    assert w.previous(w.window(date(2024, 1, 5), "month"), "mom") == (date(2023, 12, 1), date(2023, 12, 31))
    assert w.described((date(2024, 4, 1), date(2024, 6, 30))) == ("Q2 2024", "qoq")
    assert w.described((date(2024, 4, 2), date(2024, 6, 30)))[1] == "yoy"
    assert w.as_date("2024-02-03T10:00:00") == date(2024, 2, 3)
    with pytest.raises(ValueError):
        w.check_range(date(2024, 1, 1), date(2026, 1, 1), w.LONGEST_REPORT)


def values(spark, column, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates_and_numbers(spark):
    assert values(spark, t.iso_date, ["2026-02-14", "14/2/2026", "1-2-26", "1.2.88", "soon", "", None]) == ["2026-02-14", "2026-02-14", "2026-02-01", "1988-02-01", "soon", "", None]
    assert values(spark, t.parsed_date, ["2026-02-14", "5/4/2026", "13/12/2026", "12/13/2026", "05-JAN-2026", "x", None]) == [date(2026, 2, 14), date(2026, 4, 5), date(2026, 12, 13), date(2026, 12, 13), date(2026, 1, 5), None, None]
    assert values(spark, t.parsed_number, ["1,234.50", " -3 ", "2.5", "", "null", "nan", "1_000", None]) == [1234.5, -3.0, 2.5, None, None, None, None, None]
    assert values(spark, t.parsed_id, ["0A1B2C3D-0000-1111-2222-333344445555", "x", None]) == ["0a1b2c3d-0000-1111-2222-333344445555", None, None]


def test_report_month(spark):
    df = spark.createDataFrame([("2026-3", "x"), ("2026-13", "Sales MARCH 26.xlsx"), (None, "JAN_26.pdf"), (None, "26 FEB.csv"), (None, "SEPT-2025 list")], "a string, f string")
    assert [r[0] for r in df.select(t.report_month(F.col("a"), F.col("f"))).collect()] == ["2026-03", "2026-03", None, None, "2025-09"]


def test_store_names(spark):
    assert values(spark, t.store_key, ["341S387 - AMBER MEDICINES, SATELITTE", "Amber Medicines Satellite (A0039)", "Party Name : Birch & Co 1051.", " ", None]) == ["amber medicines satellite"] * 2 + ["birch co", "", ""]
    assert values(spark, t.store_core, ["Amber Medical Store, Paddhari"]) == ["amber"]
    assert values(spark, lambda c: t.city_of(c, is_store=True), ["AB12 - AMBER MEDICAL, AHEMDABAD", "CHEMIST"]) == ["ahmedabad", ""]
    assert values(spark, t.doctor_key, ["Dr. Elm (MD)  Oak", None]) == ["DR. ELM OAK", ""]
    assert values(spark, t.stockist_key, ["Cedar Agency, [CD CARE]"]) == ["cedar agency"]
    assert values(spark, t.stockist_label, ["Cedar Agency [CD CARE]"]) == ["CD CARE"]
    assert values(spark, t.clean_whitespace, [" Ａ　b ", None]) == ["A b", ""]


def test_matching_levels(spark):
    known = spark.createDataFrame([("1", 0, "Amber Tablet 10"), ("2", 0, "Birch-Syrup"), ("3", 0, "Cedar Cream 20g"), ("4", 0, "Dahlia")], "id string, ord int, name string")
    raw = spark.createDataFrame([("amber tablet 10",), ("BIRCH SYRUP",), ("cedar cream",), ("xx amber yy",), ("dahliaa drops zz",), ("Dalhia",), ("qqqq",), ("",), (None,)], "raw string")
    found = {r.raw: (r.id, r.level) for r in matching.match_names(raw, known).collect()}
    assert found == {"amber tablet 10": ("1", 1), "BIRCH SYRUP": ("2", 2), "cedar cream": ("3", 3), "xx amber yy": ("1", 4), "dahliaa drops zz": ("4", 3), "Dalhia": ("4", 5)}
    assert set(r.raw for r in matching.match_names(raw, known, strict=True).collect()) == {"amber tablet 10", "BIRCH SYRUP"}


def test_dedupe_needs_a_whole_identity(spark):
    line = ("2026-01-01", "c", "p", "1", "b1", None, None)
    rows = [line, line, (*line[:4], "", None, None), (*line[:4], "", None, None), (*line[:5], "lot", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index int, sale_date string, customer_name_raw string, product_name_raw string, sale_qty string, bill_ref string, batch string, mrp string")
    assert sorted(r.row_index for r in imp.dedupe(df).collect()) == [0, 2, 3, 4]


def test_json_keys(spark):
    df = spark.createDataFrame([('{"Item": "Amber", "qty": "2", "Party": "", "customer": "Shop"}',)], "json string")
    row = imp.from_json(df).first()
    assert (row.product_name_raw, row.sale_qty, row.customer_name_raw, row.ptr) == ("Amber", "2", "Shop", None)


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("m", "d", False, "x"), ("m", "e", True, "x")], "mr_id string, doctor_id string, is_active boolean, allocated_by string")
    new = spark.createDataFrame([("m", "d", True, "y"), ("n", "d", True, "y")], old.schema)
    once = merge.upsert(old, new, ["mr_id", "doctor_id"], ["is_active", "allocated_by"])
    assert sorted(tuple(r) for r in once.collect()) == [("m", "d", True, "y"), ("m", "e", True, "x"), ("n", "d", True, "y")]
    assert sorted(merge.upsert(once, new, ["mr_id", "doctor_id"], ["is_active", "allocated_by"]).collect()) == sorted(once.collect())
    assert merge.insert_ignore(old, new, ["mr_id", "doctor_id"]).count() == 1


def test_clusters_join_the_largest_first(spark):
    rows = [("s", "h", ["amber", "medicines", "satellite"], 1), ("s", "h", ["amber", "medicines"], 2), ("s", "h", ["amber"], 3), ("s", "h", ["birch", "chemist"], 4), ("t", "h", ["amber", "medicines"], 5)]
    df = spark.createDataFrame(rows, "stockist_id string, headquarter_id string, tokens array<string>, row_index int")
    found = {(r.stockist_id, tuple(r.tokens)): tuple(r.cluster) for r in e.cluster_stores(df).collect()}
    assert found["s", ("amber", "medicines")] == ("amber", "medicines", "satellite") and found["s", ("amber",)] == ("amber",) and found["t", ("amber", "medicines")] == ("amber", "medicines")


def test_ingest_twice_adds_nothing(spark):
    fields = ["row_index", *sheets.HEADERS]
    row = lambda i, **kw: [i, *[kw.get(f, "") for f in sheets.HEADERS]]
    rows = spark.createDataFrame([row(1, doctor_name="Elm", chemist_name="Amber Medical", stockist_name="Cedar", headquarter="North", fso_name="One"), row(2, doctor_name="Elm (MD)", chemist_name="Amber Medical Paddhari", stockist_name="CEDAR.", headquarter="north", fso_name="Who")], sheets.SCHEMA)
    assert rows.columns == fields
    stockists = spark.createDataFrame([], "id string, name string, is_active boolean")
    hqs = spark.createDataFrame([("n", "North", "s", ["d"], True)], "id string, name string, state_id string, division_ids array<string>, is_active boolean")
    stores = spark.createDataFrame([], "id string, name string, stockist_id string, headquarter_id string, address string, alternate_names array<string>, is_active boolean")
    doctors = spark.createDataFrame([], "id string, full_name string, specialization string, qualification string, phone string, address string, headquarter_id string, is_active boolean")
    users = spark.createDataFrame([("m", "One", "MR", True)], "id string, full_name string, role string, is_active boolean")
    links = spark.createDataFrame([], "doctor_id string, medical_store_id string")
    for turn in (0, 1):
        keys, new_stockists = e.resolve_stockists(rows, stockists)
        hq_keys, new_hqs, warned = e.resolve_headquarters(rows, hqs, None, None)
        groups, new_stores, _ = e.match_stores(e.group_stores(rows, keys, hq_keys), stores)
        placed, new_doctors, _ = e.match_doctors(e.group_doctors(rows, hq_keys), doctors)
        new_links = e.link(placed, groups, links)
        pairs, new_reps, _ = e.allocate(rows, placed, users, "me")
        counts = [x.count() for x in (new_stockists, new_hqs, warned, new_stores, new_doctors, new_links, new_reps)]
        assert counts == ([1, 0, 0, 1, 1, 1, 1] if turn == 0 else [0] * 7)
        stockists = spark.createDataFrame(stockists.unionByName(new_stockists.drop("key")).collect(), stockists.schema)
        stores = spark.createDataFrame(stores.unionByName(new_stores, allowMissingColumns=True).collect(), stores.schema)
        doctors = spark.createDataFrame(doctors.unionByName(new_doctors).collect(), doctors.schema)
        links = spark.createDataFrame(links.unionByName(new_links.select("doctor_id", "medical_store_id")).collect(), links.schema)
        users = spark.createDataFrame(users.unionByName(new_reps.drop("email")).collect(), users.schema)


def test_sheets(spark, tmp_path):
    (tmp_path / "pool.csv").write_text("DR NAME,LOCATION,CHEMIST NAME,LOCATION,FSO NAME\nElm,North,Amber,South,One\n,,,,\nOak,,Birch,,Two\n")
    rows = sheets.pool_file(spark, str(tmp_path / "pool.csv")).orderBy("row_index").collect()
    assert [(r.row_index, r.doctor_name, r.doctor_location, r.chemist_location) for r in rows] == [(1, "Elm", "North", "South"), (3, "Oak", "", "")]
    (tmp_path / "a.xls").write_bytes(b"PK\x03\x04xxxx")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: (r.format, r.mismatch) for r in sheets.formats(files).collect()} == {"pool.csv": ("csv", False), "a.xls": ("xlsx", True), "b.pdf": ("pdf", False)}


def test_pivots_headers_and_reps(spark):
    rows = [("f", "a", 0, ["Rep name: Elm", ""]), ("f", "a", 1, ["Item", "Qty", "Rate"]), ("f", "a", 2, ["Amber", "1", "2"]), ("f", "p", 0, ["Row Labels", "Sum of qty"]), ("f", "q", 0, ["Qty", "Sale Qty"])]
    df = spark.createDataFrame(rows, sheets.SHEETS)
    kept = sheets.without_pivots(df)
    assert {r.sheet for r in kept.collect()} == {"a"}
    assert sheets.header_rows(kept).first().header == 1
    assert sheets.rep_names(kept).first().rep == "Elm"
    assert sheets.as_text(kept).first().text == "Rep name: Elm\nItem,Qty,Rate\nAmber,1,2"


# Joins in place of scans, against what they stand for.

NAMES = ["APTIVOG TAB", "APTIVOG", "CAP APTIVOG 10S", "ZINC", "ZINC SYRUP FORTE", "IRON SYRUP", "X", "XY", "CALCIUM D3", "CALSIUM", "PARACET 500", "PARACETAMOL 650", "", "B COMPLEX", "COMPLEX B FORTE"]
RAW = ["aptivog tab", "zinc-syrup forte", "calcium gold", "APTI-VOG", "zinc syrup", "iron", "x", "y", "calciun", "paracetmol", "forte", "complex", "qqqq", "D3", "TAB", "syrop iron", "vog", "  ", "calcium d3 tablets"]


def slow_match(raw, names):
    """The levels one after the other over all names, in the order of ids."""
    plain = lambda s: " ".join(re.sub("[^A-Z0-9 ]", " ", s.upper()).split())
    norms, n = [plain(x) for x in names], plain(raw)
    for i, x in enumerate(names):
        if x and x.upper() == raw.upper().strip():
            return 1, i
    if n in norms and n:
        return 2, norms.index(n)
    for i, c in enumerate(norms):
        if c and n and (n in c or c in n):
            return 3, i
    word = next((w for w in n.split() if len(w) >= 4), None)
    for i, c in enumerate(norms):
        if word in c.split():
            return 4, i
    if n and (close := difflib.get_close_matches(n, norms, n=1, cutoff=0.6)):
        return 5, norms.index(close[0])
    return None


def test_names_match_level_by_level(spark):
    known = spark.createDataFrame([(f"{i:02}", 0, n) for i, n in enumerate(NAMES)], "id string, ord int, name string")
    got = {r.raw: (r.level, int(r.id)) for r in matching.match_names(spark.createDataFrame([(r,) for r in RAW], "raw string"), known).collect()}
    want = {r: found for r in RAW if (found := slow_match(r, NAMES)) is not None}
    assert got == want and {level for level, _ in got.values()} == {1, 2, 3, 4, 5}
    matching.SENT, matching.NAMES = 4, 3  # several blocks
    again = {r.raw: (r.level, int(r.id)) for r in matching.match_names(spark.createDataFrame([(r,) for r in RAW], "raw string"), known).collect()}
    matching.SENT, matching.NAMES = 50_000, 2_000
    assert again == want


def test_clusters_are_greedy(spark):
    rng = random.Random(4)
    sets = [(f"s{rng.randint(0, 2)}", "h", sorted(rng.sample("abcdef", rng.randint(1, 4))), i) for i in range(120)]
    got = {(r.stockist_id, tuple(r.tokens)): tuple(r.cluster) for r in entity_ingest.cluster_stores(spark.createDataFrame(sets, "stockist_id string, headquarter_id string, tokens array<string>, row_index int")).collect()}
    want = {}
    for scope in {s for s, *_ in sets}:
        first = {}
        for s, _, tokens, i in sets:
            if s == scope:
                first.setdefault(tuple(tokens), i)
        kept = []
        for tokens in sorted(first, key=lambda t: (-len(t), first[t])):
            into = next((k for k in kept if len(tokens) >= 2 and set(tokens) <= set(k)), None)
            if into is None:
                kept.append(tokens)
            want[scope, tokens] = into or tokens
    assert got == want


def test_json_rows_take_the_first_key_that_has_a_value(spark):
    rows = ['{"Qty": 1, "qty": 2}', '{"quantity": 5, "sale_qty": 3}', '{"sale_qty": "", "sales": null, " QTY ": "4.0", "Item": "A"}', '["B", "2024-01-02", "2.50"]', "[]", "{}", "not json", None]
    got = [(r.sale_qty, r.product_name_raw) for r in imp.from_json(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_index int, json string")).orderBy("row_index").collect()]
    assert got == [("1", None), ("5", None), ("4.0", "A"), ("2.50", "B"), (None, None), (None, None), (None, None), (None, None)]


def test_quantities_and_blanks(spark):
    from territory.functions.text import plain_number

    values = ["2.0", " 2.50 ", "x", "", None, "1e3", "-0.5", "7"]
    got = [r.q for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", plain_number(F.col("v")).alias("q")).orderBy("i").collect()]
    assert got == ["2", "2.5", "x", "", None, "1000", "-0.5", "7"]
    key = ("2024-01-01", "C", "P", "1", "B1", None, None)
    rows = [(0, *key), (1, " 2024-01-01", "C ", " P", "1 ", "B1", "", ""), (2, *key[:4], None, None, None), (3, *key[:4], None, None, None)]
    schema = "row_index int, sale_date string, customer_name_raw string, product_name_raw string, sale_qty string, bill_ref string, batch string, mrp string"
    assert sorted(r.row_index for r in imp.dedupe(spark.createDataFrame(rows, schema)).collect()) == [0, 2, 3]


def test_one_sale_may_be_seen(spark):
    sale = spark.createDataFrame([("m", "a", None, "s")], "mr_id string, asm_id string, rsm_id string, state_head_id string")
    see = lambda role, id, below=False: sale.where(predicates.may_see(role, id, F.lit(below))).count() == 1
    assert see("SUPER_ADMIN", "x") and see("SALES_DIRECTOR", "x") and see("MR", "m") and see("ASM", "a") and see("STATE_HEAD", "s")
    assert see("RSM", "r", True) and see("DEPUTY_RSM", "r", True) and not see("RSM", "r")
    assert not see("MR", "n", True) and not see("ASM", "b", True) and not see("?", "m", True) and not see(None, "m", True)


def test_pages_and_their_envelope(spark):
    rows = spark.range(5).select("id", F.when(F.col("id") > 3, "x").alias("name")).orderBy("id")
    total = rows.agg(F.count("*").alias("total"))
    got = json.loads(predicates.envelope(predicates.page(rows, 3, 2), total, 3, 2).first().json)
    assert got == {"success": True, "data": [{"id": 4, "name": "x"}], "message": "Operation successful", "pagination": {"page": 3, "per_page": 2, "total": 5, "total_pages": 3}}
    none = rows.limit(0)
    got = json.loads(predicates.envelope(none, none.agg(F.count("*").alias("total")), 1, 2).first().json)
    assert got["data"] == [] and got["pagination"]["total_pages"] == 0


def test_repeated_keys_of_a_source(spark):
    source = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("l", 3, "c")], "id string, n int, t string")
    assert sorted(map(tuple, merge.insert_ignore(source.limit(0), source, ["id"]).collect())) == [("k", 1, "z"), ("l", 3, "c")]


def test_workbooks_are_read_without_a_library(spark, tmp_path):
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Two" r:id="b"/><sheet name="One" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si><si><r><t>A</t></r><r><t>B</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd-mmm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" s="1"><v>45292</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {main}><sheetData><row><c t="inlineStr"><is><t>x, y</t></is></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert sheets.workbook(data.getvalue()) == [("Two", 0, [["x, y", "True"]]), ("One", 1, [["Name", "", "2.5"], ["", "", ""], ["", "AB", "2024-01-01 00:00:00"]])]
    (tmp_path / "book.csv").write_bytes(data.getvalue())
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n")
    rows = sheets.extracted(sheets.walk(spark, str(tmp_path)))
    assert sorted((r.sheet, r.row_index, r.cells[0]) for r in rows.collect()) == [("", 0, "a"), ("", 1, "1"), ("One", 0, "Name"), ("One", 1, ""), ("One", 2, ""), ("Two", 0, "x, y")]
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in sheets.as_text(rows).collect()}
    assert texts == {"plain.csv": "a,b\n1,2", "book.csv": '### SHEET: Two\n"x, y",True\n\n### SHEET: One\nName,,2.5\n,AB,2024-01-01 00:00:00'}
