import datetime as dt

from tapewright.operators import ops, research
from tapewright.sources import sinks

DAY = dt.datetime(2024, 1, 1)


def test_report_keeps_other_days(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    kind = "day string, n int"
    sinks.write_report(spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], kind), path, "day")
    sinks.write_report(spark.createDataFrame([("2024-01-02", 5)], kind), path, "day")
    assert sorted((r.day, r.n, str(r.date)) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1, "2024-01-01"), ("2024-01-02", 5, "2024-01-02")]


def test_events_by_date(spark, tmp_path):
    rows = [(1, "ws", 7, "delta", 5, None, 2, 1, DAY), (2, "ws", 7, "delta", 6, 9, 2, 1, DAY + dt.timedelta(days=1))]
    sinks.write_events(spark.createDataFrame(rows, sinks.EVENT.removesuffix(", date date")), f"file://{tmp_path}/e")
    got = {r.trace_id: r for r in sinks.read_events(spark, f"file://{tmp_path}/e").collect()}
    assert got[1].seq is None and got[2].seq == 9 and str(got[2].date) == "2024-01-02"
    assert "seq" not in next((tmp_path / "e" / "date=2024-01-01").glob("*.json")).read_text()


def test_fields_merge_over_rows(spark):
    rows = spark.createDataFrame([("A", 1, 5, None), ("A", 2, None, 7), ("A", 3, 6, None), ("B", 1, None, None)], "k string, at int, x int, y int")
    assert {r.k: (r.x, r.y) for r in ops.merged_state(rows, "k", "at", "x", "y").collect()} == {"A": (6, 7), "B": (None, None)}


def test_kaplan_meier(spark):
    rows = spark.createDataFrame([("s", d, c) for d, c in [(1, False), (1, True), (2, False), (3, True), (4, False)]], "s string, d int, c boolean")
    got = [(r.d, r.at_risk, r.ended, r.lasting) for r in research.kaplan_meier(rows, "s", "d", "c").orderBy("d").collect()]
    assert got == [(1, 5, 1, 0.8), (2, 3, 1, round(0.8 * 2 / 3, 6)), (3, 2, 0, round(0.8 * 2 / 3, 6)), (4, 1, 1, 0.0)]
