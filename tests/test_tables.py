"""Tables read by the positions of their items."""

import pytest

from evidentia.operators import tables

HEADER = "designation|resistance|surface|u projet"


def items(rows):
    return [(d, p, float(x), float(y), float(w), 8.0, t) for d, p, x, y, w, t in rows]


PAGE = items([
    (1, 1, 50, 800, 300, "Fichier 12 de l'étude"),
    (1, 1, 50, 760, 60, "Désignation"), (1, 1, 200, 760, 50, "Résistance"), (1, 1, 300, 760, 40, "Surface"), (1, 1, 400, 760, 40, "U projet"),
    (1, 1, 205, 750, 40, "m².K/W"), (1, 1, 305, 750, 20, "m²"),
    # A first cell over two lines, a value far right in its band, a missing cell.
    (1, 1, 50, 735, 90, "Mur extérieur en"), (1, 1, 215, 735, 20, "3,85"), (1, 1, 322, 735, 40, "1 250,5"), (1, 1, 410, 735, 20, "0,24"),
    (1, 1, 50, 725, 40, "béton banché"),
    (1, 1, 50, 710, 60, "Plancher bas"), (1, 1, 215, 710, 20, "4,10"), (1, 1, 410, 710, 20, "0,21"),
    # The surface of the row above stands a line lower.
    (1, 1, 310, 701, 20, "310"),
    (1, 1, 50, 690, 60, "Toiture"), (1, 1, 215, 690, 20, "7,5"), (1, 1, 310, 690, 20, "400"),
    # Far below: no more a table.
    (1, 1, 50, 600, 60, "Total"), (1, 1, 310, 600, 20, "999"),
    # Another table with other bands.
    (1, 1, 50, 500, 40, "Surface"), (1, 1, 150, 500, 60, "Désignation"), (1, 1, 60, 488, 20, "12"), (1, 1, 150, 488, 30, "Porte 1"),
    (1, 2, 50, 700, 40, "sans tableau"), (2, 1, 50, 700, 40, None),
])


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(PAGE, "doc long, page int, x double, y double, width double, height double, text string")
    return tables.cells(df.repartition(3), HEADER)


def test_bands_and_stitched_cells(found):
    got = {(r.table, r.row, r.label): r.value for r in found.collect()}
    assert got == {
        (1, 1, "Désignation"): "Mur extérieur en béton banché", (1, 1, "Résistance m².K/W"): "3,85", (1, 1, "Surface m²"): "1 250,5", (1, 1, "U projet"): "0,24",
        (1, 2, "Désignation"): "Plancher bas", (1, 2, "Résistance m².K/W"): "4,10", (1, 2, "Surface m²"): "310", (1, 2, "U projet"): "0,21",
        (1, 3, "Désignation"): "Toiture", (1, 3, "Résistance m².K/W"): "7,5", (1, 3, "Surface m²"): "400",
        (2, 1, "Surface"): "12", (2, 1, "Désignation"): "Porte 1",
    }


def test_facts_by_row_and_column(found):
    facts = tables.table_facts(found, [("^mur", "resistance", "wall_insulation_r"), ("^plancher", "surface", "floor_area"), ("^toiture", "u projet", "roof_u")])
    assert {(r.field, r.value_num) for r in facts.collect()} == {("wall_insulation_r", 3.85), ("floor_area", 310.0)}


def test_no_items(spark):
    empty = spark.createDataFrame([], "doc long, page int, x double, y double, width double, height double, text string")
    assert tables.cells(empty, HEADER).collect() == []
