"""Reports by phases take a line's numbers once for all readings of its pattern, however many parts they have."""

import datetime as dt

import evidentia.plans.reports  # noqa: F401  registers the query
from evidentia.operators import phased_layouts, phases


def test_numbers_are_taken_once(spark):
    df = phases.read(spark.createDataFrame([(1, "x")], "doc_id long, text string"), phased_layouts.LAYOUTS)
    plan = str(df._jdf.queryExecution().optimizedPlan().numberedTreeString())
    patterns = {(x.name, r.pattern, r.unless, r.strip, r.cells, r.least, r.over) for x in phased_layouts.LAYOUTS for r in x.readings}
    assert 0 < plan.count("regexp_extract_all(") <= len(patterns)


def test_numbers_of_notices_are_rounded_as_in_the_sql(spark, tmp_path):
    import duckdb
    from evidentia import catalog

    orders = [(r[0], r[1], "O", r[2], dt.datetime(2024, 1, 1), "1-URGENT") for r in [(81835, 8888, 1478.55), (147222, 11759, 1760.05)]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["phased_facts"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == {(k, b, p, f, None if v is None else float(v), t) for k, b, p, f, v, t in con.execute(catalog.SQL["phased_facts"]).fetchall()}
