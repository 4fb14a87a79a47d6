import datetime as dt

from pyspark.sql import functions as F

from tapewright.operators import ops as rules
from tapewright.plans import ops


def test_one_blocker_blocks_and_all_are_kept(spark):
    rows = [(1, "READY", 200, False), (1, "READY", 503, True), (1, "SHADOW", 200, False), (2, "READY", 200, False), (3, "READY", 503, False), (3, "READY", 200, True), (3, "READY", 200, None), *[(4, "SHADOW", 429, False)] * 7]
    r = spark.createDataFrame(rows, "account int, cls string, http_status int, transport_error boolean")
    kinds = {"unavailable": F.col("http_status") == 503, "transport": F.col("transport_error"), "rate_limited": F.col("http_status") == 429}
    got = {(x["class"], x.blocked_from, tuple(x.blockers)): x.n for x in rules.class_rollup(r, ("account",), "cls", kinds).collect()}
    assert got == {("BLOCKED", "READY", ("transport", "unavailable")): 2, ("BLOCKED", "SHADOW", ("rate_limited",)): 1, ("SHADOW", "", ()): 1, ("READY", "", ()): 1}


def test_class_rollup_query(spark, tmp_path):
    events = [(17, 1, "view"), (23 * 29, 2, "view"), (1, 3, "view"), (2, 4, "click"), (23, 4, "view")]  # 17: 429, 23: 503, 29: transport
    t = [(i, dt.datetime(2024, 1, 1), u, k, 1.0) for i, u, k in events]
    spark.createDataFrame(t, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(x["class"], x.blocked_from, tuple(x.blockers), x.n) for x in ops.class_rollup(spark, str(tmp_path)).collect()}
    assert got == {("BLOCKED", "READY", ("rate_limited",), 1), ("BLOCKED", "READY", ("transport", "unavailable"), 1), ("BLOCKED", "READY", ("unavailable",), 1), ("READY", "", (), 1), ("SHADOW", "", (), 1)}
