import datetime as dt

from pyspark.sql import functions as F

from tapewright.operators import sequence
from tapewright.plans.views import SQL, load, view

FRAMES = "arrival long, epoch int, sid long, ticker string, kind string, side string, price_cents int, qty long, seq long, ts timestamp_ntz"
SF = "/root/testdata/sf0.001"


def largest(df):
    """Rows of the task that has most."""
    return max(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())


def test_a_stream_is_no_single_task(spark):
    """One stream with one book: its frames are classified and labelled by several tasks."""
    n = 8000
    rows = [(i, 1, 0, "M", "snapshot" if i % 5 == 0 else "delta", "yes", 40 + i % 7, 3, i + 3 * (i > 5000), dt.datetime(2024, 1, 1)) for i in range(n)]
    frames = spark.createDataFrame(rows, FRAMES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert largest(sequence.classified(frames)) < 0.8 * n
        assert largest(sequence.labelled(frames)) < 0.8 * n
        assert largest(sequence.validity(frames)) < 0.8 * n / 5
        assert largest(sequence.top_depths(frames, 3)) < 0.8 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in sequence.validity(frames).where("reason <> 'next_snapshot'").select("segment", "end", "reason").orderBy("segment").collect()] == [(5000, 5001, "sid_gap"), (7995, None, "open")]


def test_numbers_of_the_frames_are_those_of_the_sql(spark):
    load(spark, SF, "events").createOrReplaceTempView("events")
    want, got = spark.sql(SQL["frames"]), view(spark, SF, "frames")
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not any("partitionBy" in x or "Window" in x for x in got._jdf.queryExecution().executedPlan().toString().split())
