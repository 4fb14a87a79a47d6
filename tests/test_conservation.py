import datetime as dt

from tapewright.operators import research
from tapewright.plans import research as plans
from tapewright.plans import views

DAY = dt.datetime(2024, 1, 1)


def tables(spark, tmp_path):
    t = [(i, DAY + dt.timedelta(days=i % 3), i % 5, "purchase" if i % 2 else "view", 1.0) for i in range(1, 31)]
    spark.createDataFrame(t, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def states(df):
    return {(r.channel, r.day): (r.expected, r.actual, r.state) for r in df.collect() if r.state != "EXACT"}


def test_tallies_show_each_kind_of_difference(spark):
    at = lambda d: DAY + dt.timedelta(days=d)
    kind = "id long, ts timestamp_ntz"
    declared = spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(1)), (4, at(2)), (5, at(3)), (6, at(3)), (7, at(5))], kind)
    read = spark.createDataFrame([(1, at(0)), (3, at(1)), (3, at(1)), (5, at(3)), (5, at(3)), (8, at(4)), (7, at(5))], kind)
    got = states(research.conserved(research.tally(declared, "c", "id"), research.tally(read, "c", "id")))
    assert got == {("c", "2024-01-01"): (2, 1, "LOST"), ("c", "2024-01-02"): (1, 2, "DOUBLED"), ("c", "2024-01-03"): (1, 0, "MISSING"), ("c", "2024-01-04"): (2, 2, "REPLACED"), ("c", "2024-01-05"): (0, 1, "EXTRA")}


def test_query_shows_rows_that_a_view_loses_or_doubles(spark, tmp_path, monkeypatch):
    d = tables(spark, tmp_path)
    q = plans.QUERIES["row_conservation"]
    assert q(spark, d).count() == 9 and not states(q(spark, d))
    monkeypatch.setitem(views.SQL, "l1", views.SQL["l1"] + " where event_id % 3 <> 0")
    monkeypatch.setitem(views.SQL, "trades", views.SQL["trades"] + " union all " + views.SQL["trades"] + " and event_id = 1")
    assert states(q(spark, d)) == {("l1", "2024-01-01"): (10, 0, "MISSING"), ("trades", "2024-01-02"): (5, 6, "DOUBLED")}
