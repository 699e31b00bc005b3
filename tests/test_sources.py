"""Sources, sinks, layouts and rules on small inputs with nulls, empty texts, ties and repeated rows."""

import io
import zipfile

import pytest
from evidentia.functions import names
from evidentia.operators import constraints, extract, folders, fusion, headers, joins, layouts, measures, sanity, search, stats
from evidentia.sources import pages, re2020, sinks
from evidentia.streaming import journal
from pyspark.sql import functions as F


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Lots &amp; prix" sheetId="1"/><sheet name="vide" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Lot</t></si><si><r><t>Prix</t></r><r><t> HT</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><dimension ref="A1:ZZ9999"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>CVC</t></is></c><c r="B3"/><c r="C3"><v>12.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet><sheetData/></worksheet>")
    return out.getvalue()


def test_spreadsheets(spark):
    files = spark.createDataFrame([("a.xlsx", workbook()), ("b.xlsx", b"no zip"), ("c.xlsx", None)], "path string, content binary")
    cells = pages.spreadsheets(files)
    assert sorted((r.sheet, r.row, r.col, r.text) for r in cells.collect()) == [("Lots & prix", 0, 0, "Lot"), ("Lots & prix", 0, 2, "Prix HT"), ("Lots & prix", 2, 0, "CVC"), ("Lots & prix", 2, 2, "12.5")]
    assert [(r.row, r.text) for r in pages.sheet_lines(cells).orderBy("row").collect()] == [(0, "Lot |  | Prix HT"), (2, "CVC |  | 12.5")]
    assert tuple(pages.used_range(cells).first())[2:] == (0, 2, 0, 2)


def test_append_new_by_key_alone(spark, tmp_path):
    path = str(tmp_path / "j")
    df = spark.createDataFrame([(1, "d1"), (2, "d1")], "id int, day string")
    assert sinks.append_new(df, path, "id", "day") == 2
    assert sinks.append_new(df.withColumn("day", F.lit("d2")).union(spark.createDataFrame([(3, "d2")], df.schema)), path, "id", "day") == 1
    assert spark.read.parquet(path).count() == 3


def test_reports_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (3, "b", None)], "t int, kind string, v string")
    sinks.report(df, str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("*.csv")).read_text().startswith('"﻿t"') or next((tmp_path / "r").glob("*.csv")).read_text().startswith("﻿")
    sinks.journal_export(df, str(tmp_path / "e"), "kind", ["t"])
    assert [r.t for r in spark.read.json(str(tmp_path / "e" / "kind=a")).collect()] == [1, 2]
    assert [r.t for r in sinks.learning_pull(df, ("a",), "kind", ["t"]).collect()] == [1, 2]
    # A head and one row a sheet: the others go to further sheets, none is lost.
    assert sinks.workbook({"one": df, "two": df}, str(tmp_path / "w"), most=2) == {"one": 3, "two": 3}


def test_workbooks_keep_every_row(spark, tmp_path):
    odd = ["a & <b>", "  spaces ", "Été\u0001 \n line", None, ""]
    df = spark.range(25).selectExpr("id", "id / 8 as part", "cast(null as string) as none").repartition(2).withColumn("text", F.element_at(F.array(*map(F.lit, odd)), (F.col("id") % 5 + 1).cast("int")))
    empty = df.filter("id < 0").coalesce(1)
    assert sinks.workbook({"Été": df, "none": empty}, str(tmp_path), most=6) == {"Été": 25, "none": 0}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(str(tmp_path / "Été")).select("path", "content")
    cells = pages.spreadsheets(files).collect()
    per = {}
    for c in cells:
        per.setdefault((c.path, c.sheet), {}).setdefault(c.row, {})[c.col] = c.text
    assert all(set(rows) <= set(range(6)) and rows[0] == {0: "id", 1: "part", 2: "none", 3: "text"} for rows in per.values()) and len(per) >= 5
    got = sorted((int(r[0]), float(r[1]), r.get(3)) for rows in per.values() for at, r in rows.items() if at)
    shown = ["a & <b>", "spaces", "Été \n line", None, None]
    assert got == [(i, i / 8, shown[i % 5]) for i in range(25)]


def test_moved_sheets_have_their_names(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="B" sheetId="7" r:id="rId9"/><sheet name="gone" sheetId="8" r:id="rId4"/><sheet name="A" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet5.xml"/></Relationships>')
        for k, v in ((1, "one"), (5, "five"), (2, "old")):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("a.xlsx", out.getvalue())], "path string, content binary")
    assert {(r.sheet, r.text) for r in pages.spreadsheets(files).collect()} == {("A", "one"), ("B", "five")}


def test_registry_in_buckets_and_replays(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "reg")
    schema = "k int, v string, ts timestamp"
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 3), (1, "old", 0)], [(3, "d", 1)]]):
        spark.createDataFrame([(k, v, t) for k, v, t in rows], "k int, v string, t int").selectExpr("k", "v", "timestamp_seconds(t) AS ts").coalesce(1).write.mode("append").parquet(src)
        journal.merge_registry(spark.readStream.schema(schema).parquet(src), path, "k", ["ts"], buckets=4)
    assert sorted((r.k, r.v) for r in journal.registry(spark, path).collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_percentiles_are_exact_with_hot_groups(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 900)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 7.0), ("hot", None)]
    got = {r.g: r for r in stats.describe(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", digits=9).collect()}
    for g in ("hot", "one", "two", None):
        v = [x for k, x in rows if k == g and x is not None]
        r = got[g]
        assert (r.n, r.v_min, r.v_max) == (len(v), min(v), max(v)) and abs(r.v_mean - np.mean(v)) < 1e-6
        assert np.allclose([r.p10, r.p25, r.p50, r.p75, r.p90], np.percentile(v, [10, 25, 50, 75, 90]))


@pytest.mark.parametrize(
    ("value", "excerpt", "glued"),
    [(2012.0, "RT2012", True), (1.0, "Bat.1", True), (-20.0, "Cep-20%", True), (3.0, "Groupe T3", True), (2.0, "kgCO2e/m²", True), (12.5, "R = 12,50 m²", False), (22.94, "722,94 kWh", False), (45.0, "Cep 45 kWh", False), (6.0, "1.6.- Justification", True), (0.5, "U ,5", False), (7.0, "rien", False), (7.0, None, False), (120.0, "mur 120mm", False)],
)
def test_glued_numbers(spark, value, excerpt, glued):
    df = spark.createDataFrame([(value, excerpt)], "v double, e string")
    assert df.select(sanity.only_glued(F.col("v"), F.col("e"))).first()[0] is glued


def test_labels_and_reasons(spark):
    rows = [
        ("structure", None, "Caisson en tôle", "x", "tags:label-value", "CCTP", "label"), ("structure", None, "Béton banché", "x", "tags:label-value", "CCTP", None), ("housing_count", 45.0, "45", "Avenue à CHECY (45).", "tags:label-value", "CCTP", "label"),
        ("housing_count", 45.0, "45", "45 logements (45)", "tags:label-value", "CCTP", None), ("enr", None, "Oui", "ENR", "tags:presence", "CCTP", "mention"), ("cooling", None, "Réseau de chaleur", "x", "m", "CCTP", "no cooling"), ("dpe_ges_after", None, "312", "x", "m", "DPE", "class"),
        ("cep", None, None, None, None, None, None), ("ic_lot_4", 2000.0, None, None, "m", None, "range"), ("wall_structure", None, "Autre Non", "x", "m", None, "other"), ("cep", 9999.0, None, None, "xml:x", None, None), ("roof_structure", None, "terrasse", "x", "tags:label-value", "Document inconnu", "unknown document"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, field string, value_num double, value_text string, excerpt string, method string, doc_type string, want string").withColumn("validated", F.lit(None).cast("boolean")).withColumn("structured", F.lit(False))
    got = df.select("i", "want", sanity.reason(df).alias("why")).orderBy("i").collect()
    assert [(r.i, r.why) for r in got] == [(r.i, r.want) for r in got]
    assert sanity.allowed(spark.createDataFrame([("a", "x"), ("a", "y")], "family string, field string"), spark.createDataFrame([("a", "x"), ("a", "x")], "family string, field string")).count() == 1


def test_fallback_raises_beyond_its_bound_and_keeps_equal_rows(spark):
    rows = spark.createDataFrame([("all", 1), ("a", 2)], "building string, v int")
    with pytest.raises(Exception, match="more than 1 buildings"):
        joins.global_fallback(rows, spark.createDataFrame([("a",), ("b",)], "building string"), "all", most=1).collect()
    assert joins.global_fallback(rows, spark.createDataFrame([("a",), ("b",)], "building string"), "all").count() == 3
    left = spark.createDataFrame([(1, 5.0), (1, 5.0)], "k int, x double")
    assert joins.nearest_within(left, spark.createDataFrame([(1, 5.5, 9)], "k int, y double, t int"), "k", "x", "y", 1.0, "t").count() == 2


def test_headers_qualifiers_and_ties(spark):
    catalog = spark.createDataFrame([("cep", "Cep projet", 0), ("cep_max", "Cep max projet", 1), ("a", "surface habitable nord", 2), ("b", "surface habitable sud", 3)], "field string, label string, place int")
    h = spark.createDataFrame([("cep 2028 projet",), ("surface habitable",), ("max cep projet",), (None,), ("",)], "header string")
    assert {(r.header, r.field) for r in headers.match_headers(h, catalog).collect()} == {("max cep projet", "cep_max")}
    assert headers.match_headers(h.filter("false"), catalog).count() == 0


def test_layout_parts_and_sentences(spark):
    text = "page de garde\nBâtiment A\nCep 50\nles ouvrages du\nbâtiment réalisés sur chantiers.\nBÂTIMENT B : 1 Collectif 16 0.60 Oui\nBatiment 3117.92\nfin"
    docs = spark.createDataFrame([(1, text, "X"), (2, None, None), (3, "", "X"), (1, text, "X")], "doc_id int, text string, doc_type string")
    got = sorted({(r.doc_id, r.part, r.building, r.first_line) for r in layouts.parts(docs).collect()})
    assert got == [(1, 0, "Bâtiment A", 0), (1, 1, "Bâtiment A", 1), (2, 0, names.UNIQUE, 0), (3, 0, names.UNIQUE, 0)] or (1, 2, "Bâtiment B", 5) in got
    assert layouts.parse(docs.filter("false")).count() == 0
    announced = spark.createDataFrame([(1, "Nombre de bâtiments du projet : 2\nBâtiment A\nx"), (2, "Nombre de bâtiments du projet : 1\nBâtiment A")], "doc_id int, text string")
    assert {(r.doc_id, r.complete) for r in layouts.detect_buildings(announced).collect()} == {(1, False), (2, True)}


PACK_CASES = [
    ("booklet", "LIVRET D'OPÉRATION\nN° DE CONTRAT / OPERATION : 1234 / OPE-000001\nNOM DE L'OPERATION : Les Lilas\nOUVRAGE : Collectif : 12 logements - 2 batiments\nREFERENTIEL : BEE - Version du 01/02/2024", {"contract_number": "1234", "internal_code": "OPE-000001", "operation_name": "Les Lilas", "housing_total": 12.0, "building_total": 2.0, "reference_name": "BEE", "reference_version": "01/02/2024", "work_type": "Collectif"}),
    ("dpe_recap", "Étiquette init et réno\nLgt. A12 2 T3 62,5 250 40 E D 90 12 B C", {"shab": 62.5, "dpe_energy_before": "E", "dpe_ges_before": "D", "dpe_energy_after": "B", "dpe_ges_after": "C"}),
    ("heat_loss", "Synthèse des déperditions NF EN 12831\nDépartement : 2A - Corse", {"department": "2A"}),
    ("summer_comfort", "Simulation thermique dynamique\nIl n'est pas envisagé de rafraîchir les logements\nBrise-soleil orientable", {"cooling": "Aucun", "window_shading": "BSO"}),
    ("acv_report", "Données générales Bâtiment A\nIc construction max kg éq. CO2/m² 740,5\nIc construction kg éq. CO2/m² 650,2\nIc energie kg éq. CO2/m² 200", {"ic_construction_max": 740.5, "ic_construction": 650.2, "ic_energy": 200.0}),
    ("services_summary", "Synthèse des prestations en points\n60,5/80 points 50,1 / 75 kWhEP/m² 45/70 kWhEP/m² 100/160 kg", {"bbio": 60.5, "bbio_max": 80.0, "cep": 50.1, "cep_max": 75.0, "cepnr": 45.0, "cepnr_max": 70.0, "ic_energy": 100.0, "ic_energy_max": 160.0}),
    ("financial", "Questionnaire financier\nOPE-123456\nN° du contrat : 00123", {"internal_code": "OPE-123456", "contract_number": "00123"}),
]


@pytest.mark.parametrize(("pack", "text", "want"), PACK_CASES, ids=[c[0] for c in PACK_CASES])
def test_packs_by_signature(spark, pack, text, want):
    got = {r.field: r.value_num if r.value_num is not None else r.value_text for r in layouts.parse(spark.createDataFrame([(1, text, None)], "doc_id int, text string, doc_type string")).collect()}
    assert {k: got.get(k) for k in want} == want


FAMILY_CASES = [
    ("RSET_RE2020", "Coefficient Bbio 60,5 80 12\nCoefficient Cep,nr 45 70 5\nDH 350,5 °C.h\nDH max 1250", {"bbio": 60.5, "bbio_max": 80.0, "bbio_gain": 12.0, "cepnr": 45.0, "cepnr_max": 70.0, "dh": 350.5, "dh_max": 1250.0}),
    ("RT2012", "Groupe 1 26,1 28,5 -3,2 Conforme", {"tic": 26.1, "tic_ref": 28.5}),
    ("RT_EXISTING", "Ubat initial : 1,25 W/m².K\nUbat projet 0,6\nCep initial = 250\nEtat existant 185.7 0.82 D F", {"ubat_before": 1.25, "ubat_after": 0.6, "cep_before": 250.0, "dpe_energy_before": "D", "dpe_ges_before": "F"}),
    ("CARBON", "Ic énergie kgCO2e/m² : 120\nStockage carbone Stock,C (par m²) : 45,5 kgC/m²\nIc énergie chauffage = 30", {"ic_energy": 120.0, "stock_c_per_m2": 45.5, "ic_energy_heating": 30.0}),
    ("DPE", "Etat initial\nClasse énergie : F\nAprès travaux\nClasse énergie : B", {"dpe_energy_before": "F", "dpe_energy_after": "B"}),
    (None, "Adresse de l'opération : 12 rue des Lilas, 75011 Paris\nAnnée de construction : 1962\nBbio max = 60\nCep : 45,2 kWh", {"address": "12 rue des Lilas", "postcode": "75011", "city": "Paris", "construction_year": 1962.0, "bbio_max": 60.0, "cep": 45.2}),
]


@pytest.mark.parametrize(("kind", "text", "want"), FAMILY_CASES, ids=[str(c[0]) for c in FAMILY_CASES])
def test_packs_by_family(spark, kind, text, want):
    got = {r.field: r.value_num if r.value_num is not None else r.value_text for r in layouts.parse(spark.createDataFrame([(1, text, kind)], "doc_id int, text string, doc_type string")).collect()}
    assert {k: got.get(k) for k in want} == want


def test_rules_are_valid():
    assert extract.check_rules(layouts.rules()) == []


def test_xml_that_is_none(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "<projet><broken"), (4, "<other/>"), (5, "<projet><RSET><Sortie_Projet/></RSET></projet>")], "id int, xml string")
    assert re2020.facts(re2020.buildings(re2020.parse(d, "id", "xml"))).count() == 0 and re2020.envelope(re2020.parse(d, "id", "xml")).count() == 0


def test_small_functions(spark):
    r = spark.range(1).select(
        measures.length_in_metres(F.lit("350 cm")).alias("cm"), measures.length_in_metres(F.lit("2,5 m")).alias("m"), measures.length_in_metres(F.lit("x")).alias("none"), measures.scale(F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 4D))"), F.lit(10.0)).alias("scale"),
        measures.layers(F.lit("2x150 mm + PB 13 mm"))["total"].alias("layers"), measures.resistance(F.lit("λ 0,038"), F.lit(140)).alias("r"), measures.first_match(F.lit("Chauffe-eau"), [("a", "x"), ("b", "chauffe")]).alias("first"), folders.plan_format(F.lit("Plan RDC.pdf"), F.lit(1191), F.lit(842)).alias("a3"),
        folders.plan_format(F.lit("CCTP.pdf"), F.lit(3400), F.lit(842)).alias("written"), fusion.scoped(F.lit("cep"), F.lit("Performance énergétique")).alias("scoped"), constraints.wall_side(F.lit("ITE et doublage")).alias("side"), folders.reread(F.lit("CCTP lot plomberie.pdf"), F.lit("cctp"), ["plans"], ["plomberie"]).alias("again"),
        search.cell("number", F.lit(None).cast("string"), F.lit("PRESENT"), F.lit(False), F.array(F.lit(2.5), F.lit(3.0), F.lit(2.5)), F.lit("t")).alias("cell"), search.cell("presence", F.lit("Non"), F.lit("PRESENT"), F.lit(False), F.array().cast("array<double>"), F.lit("t")).alias("manual"), search.cell("presence", F.lit(""), F.lit("UNDETERMINED"), F.lit(True), F.array().cast("array<double>"), F.lit("t")).alias("contrary"),
    ).first()
    assert tuple(r) == (3.5, 2.5, None, 2.0, 300.0, 3.7, "b", "A3", None, True, "ite", True, "2.5 ; 3", "Non", "Non conforme")
    made = search.normalized([{"id": "a", "keywords": "x; y\nz", "low": "1,5", "junk": 1}, {"id": "a", "theme": "t", "keywords": ["k"]}, {"theme": "no id"}])
    assert len(made) == 1 and made[0].theme == "t" and made[0].keywords == ("k",) and search.normalized([{"id": "b", "keywords": "x; y\nz", "low": "1,5"}])[0].keywords == ("x", "y", "z")


def test_field_criteria_and_free_search_bounds(spark):
    finals = spark.createDataFrame([("o", "a", "cep", 50.0), ("o", "b", "cep", 90.0), ("p", "a", "cep", 90.0), ("q", "a", "dh", 1.0)], "operation string, building string, field string, value_num double")
    c = [search.Criterion("low", "t", (), kind="field", field="cep", high=60.0)]
    assert {(r.operation, r.status, r.contrary) for r in search.field_criteria(finals, c).collect()} == {("o", "PRESENT", False), ("p", "NOT_GIVEN", True), ("q", "NOT_GIVEN", False)}
    docs = spark.createDataFrame([(1, "Surface habitable : 120,5 m²\nArticle 7"), (2, "surface de façade 300"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.idx, r.value) for r in search.free_search(docs, "surface habitable").collect()] == [(1, 0, 120.5)]
    with pytest.raises(ValueError):
        search.free_search(docs, "?")
