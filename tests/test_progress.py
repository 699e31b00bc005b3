"""The stream of progress: cuts into batches and restarts change nothing."""

import datetime as dt
import random

from evidentia.streaming import progress

SCHEMA = "job long, ts timestamp, id long, doc long, progress double, docs long, prior double"

def run(spark, source, top):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    with progress.rocks(spark):
        q = progress.estimates(stream, 3_600_000, "10 minutes").writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/offsets").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{top}/rows").collect()), key=repr)

def test_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    start, at, rows = dt.datetime(2024, 1, 1), 0.0, []
    for i in range(240):
        at += rng.choice([0.1, 2, 90, 900, 5000]) if rng.random() < 0.9 else 9000
        rows.append((rng.randint(1, 2), start + dt.timedelta(seconds=at), i, rng.randint(0, 3), rng.random() * 1.2, 4, rng.choice([None, 30.0])))
    rows.append((3, None, 999, 1, 0.5, 4, None))
    write = lambda part, folder: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    write(rows, tmp_path / "whole")
    whole = run(spark, str(tmp_path / "whole"), str(tmp_path / "a"))
    parts = tmp_path / "parts"
    for k in range(0, 120, 40):
        # Events within a file are in no order.
        write(rng.sample(rows[k : k + 40], 40), parts)
    first = run(spark, str(parts), str(tmp_path / "b"))
    for k in range(120, 240, 40):
        write(rng.sample(rows[k : k + 40], 40), parts)
    assert run(spark, str(parts), str(tmp_path / "b")) == whole
    assert set(first) < set(whole) and {r[2] for r in whole} == {"progress", "closed"}
    # A job that is begun anew has no work of the old one.
    assert sum(r[2] == "closed" for r in whole) > 10

def test_smoothing_by_hand(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, t(0), 1, 0, 0.1, 2, 10.0), (1, t(0.2), 2, 0, 0.2, 2, 10.0), (1, t(5), 3, 0, 0.5, 2, None), (1, t(10), 4, 1, 2.0, 2, None), (9, t(8000), 5, 0, 1.0, 1, None), (9, t(80000), 6, 0, 1.0, 1, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = [r for r in run(spark, str(tmp_path / "in"), str(tmp_path / "out")) if r[0] == 1]
    base = 1704067200000
    second, third = 20 * 0.72 + 20 * 0.28, (20 * 0.72 + 20 * 0.28) * 0.72 + 10 / 0.75 * 0.28
    want = [(1, base, "progress", 0.001, 0.05, 20.0, 19.999), (1, base + 5000, "progress", 5.0, 0.25, second, second - 5), (1, base + 10000, "progress", 10.0, 0.75, third, third - 10), (1, base + 10000, "closed", 10.0, 0.75, third, 0.0)]
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got] == sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want], key=repr)

def test_times_are_rounded_to_the_nearest_millisecond(spark, tmp_path):
    t = lambda us: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)
    rows = [(1, t(499), 1, 0, 0.1, 2, None), (1, t(2_000_500), 2, 0, 0.2, 2, None), (9, t(700_000_000_000), 3, 0, 1.0, 1, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = [r for r in run(spark, str(tmp_path / "in"), str(tmp_path / "out")) if r[0] == 1]
    base = 1704067200000
    assert [r[1:4] for r in got] == [(base, "progress", 0.001), (base + 2001, "closed", 2.001), (base + 2001, "progress", 2.001)]
