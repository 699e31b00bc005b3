"""Labels of reports taken for buildings, and what they put behind a name."""

from pyspark.sql import functions as F

from evidentia.functions import names
from evidentia.operators import layouts

WRONG = [
    "Bâtiment A USAGE", "Bâtiment à usage d'habitation", "Bâtiment REGLEMENTAIRE", "Bâtiment ENTIEREMENT CHAUFFEE EXTERIEURE", "Bâtiment SRTZ CONSOMMATIONS ET PRODUCTIONS ANNUELLES DU BATIMENT (PAR ZONES) PAR", "Bâtiment LIVRE SANS SYSTEME DE CHAUFFAGE",
    "Bâtiment ZONES GROUPES", "Bâtiment EN CAS DE MESURE GLOBALE", "Bâtiment BATIMENT", "Bâtiment 257 KW.", "Bâtiment CONDITIONS DE BASE", "Bâtiment T1 T2 T3 T4 T5 TOTAL", "Bâtiment (RESIDENCE", "Bâtiment BKWH ENERGIE FINALE/M2 SREF", "Bâtiment 12,5", "Bâtiment ---", None,
]
MENDED = {
    "Bâtiment Q CALICOTS - 08-02-2020": "Bâtiment Q CALICOTS", "Bâtiment Q CALICOTS - RAPPORT PROMOTELEC": "Bâtiment Q CALICOTS", "Bâtiment Q CALICOTS - UBAT - 08-02-2020 - PAGE 116 / 135 -": "Bâtiment Q CALICOTS",
    "Bâtiment COLLECTIF - BATIMENT NEUF CONSOMMATIONS": "Bâtiment COLLECTIF", "Bâtiment B - RT2012": "Bâtiment B", "Bâtiment (BATIMENT AB": "Bâtiment AB", "Bâtiment CBATIMENT C": "Bâtiment C", "Bâtiment B...................................73": "Bâtiment B",
    "Bâtiment SUD REGLEMENTAIRE": "Bâtiment SUD", "Bâtiment 1 Collectif 16 0.60 Oui": "Bâtiment 1", "Bâtiment A 1516": "Bâtiment A", "Bâtiment 3 3300 2750": "Bâtiment 3", "Bâtiment B.": "Bâtiment B",
}
KEPT = ["Bâtiment A", "Bâtiment 1", "Bâtiment COLLECTIF", "Bâtiment SOCIAL", "Bâtiment MAISONS 1 ET 3", "Bâtiment M1 IDEM M2", "Bâtiment MAISONS 1/2-5/6-16/17 (LE PLUS DEFAVORABLE)", "Bâtiment D (87 LOGEMENTS)", "Bâtiment SUR RUE", "Bâtiment G CAGE B (16 LGTS)", "Bâtiment CATALPA", names.UNIQUE]


def test_repair(spark):
    want = {**dict.fromkeys(WRONG), **MENDED, **{n: n for n in KEPT}}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.r for r in df.select("n", names.repair(F.col("n")).alias("r")).collect()} == want


def test_a_heading_alone_is_no_building(spark):
    docs = spark.createDataFrame([(1, "Batiment a usage\nBatiment a usage"), (2, "Bâtiment : Q CALICOTS - RAPPORT PROMOTELEC\nx\nBâtiment : Q CALICOTS - 08-02-2020\ny"), (3, "Bâtiment A\nBâtiment : B")], "doc_id int, text string")
    got = {}
    for r in layouts.detect_buildings(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.building)
    assert got == {1: {names.UNIQUE}, 2: {"Bâtiment Q CALICOTS"}, 3: {"Bâtiment A", "Bâtiment B"}}
