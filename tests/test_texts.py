import datetime as dt

import pytest
from evidentia.functions import numbers
from evidentia.operators import extract, search
from evidentia.sources import formats, lines, sinks
from pyspark.sql import functions as F


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


@pytest.mark.parametrize(
    ("text", "value"),
    [("12 345,5 m", 12345.5), ("1\u202f234", 1234.0), ("12 3456", 12.0), ("\u22123,5", -3.5), ("1.234.567", None), ("none", None), ("", None), (None, None), ("R 2,10 et 3", 2.1)],
)
def test_fr_number(spark, text, value):
    assert one(spark, text, numbers.fr_number(F.col("t")))[0] == value


def test_numbers_in_leaves_out_glued_ones(spark):
    got = one(spark, "RE2020 R4 12 345 m 3,5 et 7a, 8.25; 1.2.3", numbers.numbers_in(F.col("t")))[0]
    assert got == [12345.0, 3.5, 8.25]
    assert one(spark, "Surface 120 m2, 3 m2 et 5 mm", numbers.number_with_unit(F.col("t"), "m2"))[0] == [120.0, 3.0]


def test_names_of_files(spark):
    r = one(spark, "Étude_IND C_2024-03-05.pdf", numbers.revision(F.col("t")), numbers.iso_date(F.col("t")))
    assert tuple(r) == (3.0, dt.date(2024, 3, 5))
    assert one(spark, "plan V1.8 99-99-2024.pdf", numbers.revision(F.col("t")), numbers.iso_date(F.col("t")))[:] == (1.08, None)
    assert one(spark, None, numbers.revision(F.col("t")), numbers.contract_key(F.col("t")))[:] == (None, None)


def test_versions_sort_by_number(spark):
    rows = spark.createDataFrame([("1.10",), ("1.9",), ("1.9.1",), ("2",)], "v string").orderBy(numbers.version_key(F.col("v"))).collect()
    assert [r.v for r in rows] == ["1.9", "1.9.1", "1.10", "2"]


RULES = [
    extract.Rule("s", "surface", "Surface : ([0-9 ,]+)", section_start="BATIMENT ([A-Z])", section_end="FIN"),
    extract.Rule("m", "max", "R = ([0-9,]+)", selection="max"),
    extract.Rule("w", "word", "mot ([a-z]+)", kind="text", selection="all", max_matches=2),
    extract.Rule("c", "flag", kind="constant", constant="Oui", require_any=("isolation",), forbid_any=("sans",), doc_types=("thermal",)),
]


def test_rules_with_sections_gates_and_selection(spark):
    text = "Surface : 1\nBATIMENT A Surface : 1 200,5 FIN Surface : 3 BATIMENT B Surface : 20\nR = 2,5 R = 3,25 mot un mot deux mot trois isolation"
    docs = spark.createDataFrame([(1, text, "thermal", 9), (2, text + " SANS", "thermal", 9), (3, text, "other", 9), (4, None, None, 9), (5, "", "thermal", 9)], "doc_id int, text string, kind string, rule int")
    got = sorted((r.doc_id, r.field, r.section, r.value_num, r.value_text) for r in extract.facts(docs, RULES, type_col="kind").collect() if r.doc_id in (1, 4, 5))
    assert got == [(1, "flag", "", None, "Oui"), (1, "max", "", 3.25, None), (1, "surface", "A", 1200.5, None), (1, "surface", "B", 20.0, None), (1, "word", "", None, "deux"), (1, "word", "", None, "un")]
    assert {r.doc_id for r in extract.facts(docs, RULES, type_col="kind").collect() if r.field == "flag"} == {1}
    assert extract.facts(docs.limit(0), RULES, type_col="kind").count() == 0


def test_faulty_rules_are_named():
    bad = [extract.Rule("a", "f", "x"), extract.Rule("a", "f", kind="text", selection="min")]
    assert extract.check_rules(bad) == ["a: repeated id", "a: pattern missing or longer than 1200", "a: min and max are for numbers"]


def test_tagged_takes_the_next_line_unless_it_is_a_tag(spark):
    docs = spark.createDataFrame([(1, "État :\nbon\nNiveau =\nÉTAT: neuf"), (2, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.idx, r.field, r.value) for r in extract.tagged(docs, {"state": ["état"], "level": ["niveau"]}).collect())
    assert got == [(1, 0, "state", "bon"), (1, 2, "level", "ÉTAT: neuf")] or got == [(1, 0, "state", "bon"), (1, 3, "state", "neuf")]
    assert (1, 3, "state", "neuf") in got


def test_classify_and_vote(spark):
    c = one(spark, "carbone carbone thermique", extract.classify(F.col("t"), [("acv", "carbone", 4), ("rset", "thermique", 5)], [("rset", "carbone", 0.5)]))[0]
    assert (c.doc_type, c.score) == ("acv", 4.0)
    assert one(spark, "", extract.classify(F.col("t"), [("acv", "carbone", 4)]))[0].doc_type == "generic"
    v = one(spark, "x", extract.vote(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("c")), extract.vote(F.lit(None), F.lit("b"), F.lit(None), F.lit("c")))
    assert (v[0].doc_type, v[0].doubt, v[1].doc_type, v[1].doubt) == ("b", None, "c", "b / c")
    assert one(spark, "Cep max\n : 52,5 kWh", extract.value_after(F.col("t"), "cep max"))[0] == 52.5


def test_terms():
    assert search.term_pattern("") is None and search.term_pattern("re:(") is None and search.term_pattern("re:a+") == "a+"


def test_grid_states_and_themes(spark):
    c = [search.Criterion("pv", "energy", ("panneau solaire",), negative=("sans",), required=True), search.Criterion("u", "shell", ("uw",), kind="number", low=1, high=1.5), search.Criterion("near", "shell", ("isolant",), context=("façade",), window=1, inferred=True)]
    docs = spark.createDataFrame([(1, "Panneaux-solaires\nUw 1,3\nfaçade\nisolant"), (2, "sans panneau solaire\nuw 2\nisolant\n\nfaçade"), (3, None)], "doc_id int, text string")
    g = search.grid(docs, c)
    got = {(r.doc_id, r.criterion): (r.status, r.first_line) for r in g.collect()}
    assert [got[1, k] for k in ("pv", "u", "near")] == [("PRESENT", 0), ("PRESENT", 1), ("PRESENT", 3)]
    assert [got[2, k][0] for k in ("pv", "u", "near")] == ["ABSENT_EXPLICIT", "NOT_GIVEN", "ABSENT_INFERRED"]
    assert [got[3, k][0] for k in ("pv", "u", "near")] == ["UNDETERMINED", "NOT_GIVEN", "UNDETERMINED"]
    assert {(r.doc_id, r.theme): r.ok for r in search.themes(g).collect()}[1, "energy"]


def test_context_and_blocks(spark):
    docs = spark.createDataFrame([(1, "a:\nb\nc.\n1. d"), (2, None)], "doc_id int, text string")
    assert sorted((r.idx, r.context) for r in lines.with_context(docs, 1, 1).collect() if r.doc_id == 1) == [(0, "a: | b"), (1, "a: | b | c."), (2, "b | c. | 1. d"), (3, "c. | 1. d")]
    assert sorted((r.idx, r.block) for r in lines.sentence_block(docs).collect()) == [(0, ""), (0, "a:"), (1, "a: b"), (2, "c."), (3, "1. d")]


def test_separated_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('code;nom\n1;"a;b ""c"""\n'.encode())
    (tmp_path / "b.csv").write_bytes("nom,ville\nété,Ré\n€,–\n".encode("cp1252"))
    got = sorted((r.path[-5:], r.idx, r.cells) for r in formats.separated(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 0, ["code", "nom"]), ("a.csv", 1, ["1", 'a;b "c"']), ("b.csv", 0, ["nom", "ville"]), ("b.csv", 1, ["été", "Ré"]), ("b.csv", 2, ["€", "–"])]


def test_tables_and_leaves(spark):
    page = "<table><tr><th>Code</th><th>Nom</th></tr><tr><td>1</td><td>A &amp; <b>B</b></td></tr></table>"
    cells = formats.html_cells(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html")
    assert sorted((r.row, r.col, r.text) for r in cells.collect()) == [(0, 0, "Code"), (0, 1, "Nom"), (1, 0, "1"), (1, 1, "A & B")]
    assert formats.header_row(cells, ["id"], ("code", "nom")).first().row == 0
    x = spark.createDataFrame([(1, "<?xml version='1.0'?><p><!-- n --><ns:a k='>'>1 &amp; 2</ns:a><b><c> x </c><e/></b></p>"), (2, "<broken"), (3, None), (4, "<p><a>1<b>2</p>"), (5, "</x><p><![CDATA[a<b]]></q></p>")], "id int, xml string")
    got = [(r.id, r.path, r.value) for r in formats.xml_leaves(x, "id", "xml").collect()]
    assert got == [(1, "/p/a", "1 & 2"), (1, "/p/b/c", "x"), (4, "/p/a/b", "2"), (5, "/p", "a<b")]
    links = formats.html_links(spark.createDataFrame([(1, """<a class=x href='a b'>1</a><A HREF = c>2</A><a title="href=n">3</a><abbr href="d"><a href="e">"""), (2, None)], "id int, html string"), "id", "html")
    assert [(r.idx, r.href) for r in links.orderBy("idx").collect()] == [(0, "a b"), (1, "c"), (2, "e")]


def test_separated_files_in_splits(spark, tmp_path):
    rows = [f"{i};x{i}" for i in range(3000)]
    (tmp_path / "big.csv").write_text("a;b\n" + "\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = formats.separated(spark, str(tmp_path)).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.idx for r in got] == list(range(3001)) and got[1].cells == ["0", "x0"] and got[3000].cells == ["2999", "x2999"]


def test_items_and_ocr(spark):
    items = [(1, 50.0, 700.0, 10.0, 10.0, "B"), (1, 10.0, 701.0, 10.0, 20.0, "A"), (1, 61.0, 700.0, 10.0, 5.0, "C"), (1, 10.0, 600.0, 10.0, 5.0, "D")]
    df = spark.createDataFrame(items, "page int, x double, y double, height double, width double, text string")
    assert [(r.line, r.text) for r in formats.assemble(df, ["page"]).orderBy("line").collect()] == [(0, "A BC"), (1, "D")]
    native, ocr = spark.createDataFrame([(1, "un deux trois")], "page int, text string"), spark.createDataFrame([(1, "UN deux trois"), (1, "quatre cinq"), (1, None)], "page int, text string")
    assert sorted((r.text, r.origin) for r in formats.merge_ocr(native, ocr, ["page"]).collect()) == [("quatre cinq", "ocr"), ("un deux trois", "native")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", 'a"b'), (1, "2024-01-01", 'a"b'), (2, "2024-01-02", "c")], "id int, day string, t string")
    p = str(tmp_path / "journal")
    assert sinks.append_new(df, p, "id", "day") == 2
    assert sinks.append_new(df, p, "id", "day") == 0
    sinks.report(df, str(tmp_path / "r"))
    assert any('"a""b"' in f.read_text() for f in (tmp_path / "r").glob("*.csv"))
    sinks.session_lines(df, "id", str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    sinks.results(df, str(tmp_path / "q"), "day")
    sinks.results(df.filter("id = 2"), str(tmp_path / "q"), "day")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 3
