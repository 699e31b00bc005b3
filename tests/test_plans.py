"""What costs much is in a plan once: nothing is put into each place that uses it."""

from pyspark.sql import functions as F

from evidentia.operators import search
from evidentia.sources import re2020

def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()

def test_grid_looks_for_a_term_once_or_twice_a_line(spark):
    docs = spark.createDataFrame([(1, "a zebra\nzebras 2,4")], "doc_id int, text string")
    c = search.Criterion("z", "t", ("zebra",), kind="number", low=2, high=3, negative=("never",))
    found = search.grid(docs, [c])
    assert plan(found).count("zebra") <= 2 and plan(found).count("never") <= 2
    assert [(r["status"], r["first_line"], r["values"]) for r in found.collect()] == [("PRESENT", 0, [2.4, 2.4])]

def test_studies_are_parsed_once(spark):
    docs = spark.createDataFrame([(1, "<projet/>")], "id int, xml string").filter(F.rand() < 2)
    assert plan(re2020.envelope(re2020.parse(docs, "id", "xml"))).count("from_xml") == 1
    assert plan(re2020.buildings(re2020.parse(docs, "id", "xml"))).count("from_xml") == 1

def test_rows_for_every_sheet_or_document_are_not_broadcast(spark):
    from evidentia.operators import headers, layouts

    few = spark.range(10)
    cells = few.select(F.col("id").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in ((0, 0, "Contrat"), (1, 0, "123"))])))
    for found in (headers.export_records(cells), headers.contract_column(cells)):
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert headers.export_records(cells).filter("contract = '00000123'").count() == 10
    docs = few.select(F.col("id").alias("doc_id"), F.concat(F.lit("Note "), F.col("id").cast("string")).alias("text"), F.lit("CCTP").alias("doc_type"))
    found = layouts.clean_facts(docs, {})._jdf.queryExecution()
    # The texts are read by the packs, by the phases and for the families.
    assert found.optimizedPlan().toString().count("Range (") == 3 and "Broadcast" not in found.sparkPlan().toString()
