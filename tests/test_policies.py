import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.operators import policies, sequence

T0 = dt.datetime(2024, 1, 1)
D = [dt.date(2024, 1, 1 + i) for i in range(6)]
TR = "trade_id long, ts timestamp_ntz, ticker string, size int"
PRINTS = "ticker string, day date, price_cents int, size int, taken boolean, yes_wins boolean, taker_rate_e4 int"


def hour(h):
    return T0 + dt.timedelta(hours=h)


def test_a_follower_moves_after_its_leader(spark):
    l1 = spark.createDataFrame([(1, hour(0), "A", 40, 42), (2, hour(0), "B", 40, 42), (3, hour(1), "A", 45, 47), (4, hour(2), "B", 44, 46), (5, hour(3), "B", 43, 45), (6, hour(50), "A", 50, 52), (7, hour(50), "B", 50, 52)], "event_id long, ts timestamp_ntz, ticker string, yes_bid int, yes_ask int")
    links = spark.createDataFrame([("E", "A", "B"), ("E", "B", "A")], "event_ticker string, leader string, follower string")
    got = {r.leader: tuple(r)[3:] for r in policies.lead_lag(l1, links, 24).collect()}
    assert got == {"A": (3, 2, 1, 1, 0, 3600.0), "B": (2, 0, 0, 0, 0, None)}


def test_ranks_use_the_past_only(spark):
    t = spark.createDataFrame([(i, hour(i), "A", s) for i, s in enumerate((1, 2, 2, 9, 1))], TR)
    got = [r.past_rank for r in policies.past_rank(t, range(-7, 10)).orderBy("trade_id").collect()]
    assert got == [None, 1.0, 0.5, 1.0, 0.0]
    assert [r.past_rank for r in policies.past_rank(t.where("trade_id < 3"), range(-7, 10)).orderBy("trade_id").collect()] == got[:3]
    with pytest.raises(Exception, match="outside the bins"):
        policies.past_rank(t.withColumn("size", F.lit(10)), range(-7, 10)).collect()


def test_capital_is_held_until_settlement(spark):
    opens = spark.createDataFrame([("k", "A", D[0], 10), ("k", "A", D[1], 5), ("k", "B", D[1], 7), ("k", "B", D[2], 20)], "k string, ticker string, ts date, cap long")
    settled = spark.createDataFrame([("A", D[1]), ("B", D[3])], "ticker string, ts date")
    got = [(r.ts, r.step, r.capital) for r in policies.running_capital(opens, settled, "k").orderBy("ts", "step").collect()]
    assert got == [(D[0], 0, 10), (D[1], 0, 22), (D[1], 1, 7), (D[2], 0, 27), (D[3], 1, 0)]
    prints = spark.createDataFrame([("A", D[0], 10, 1, True, True, 0)] * 30 + [("B", D[0], 10, 1, True, True, None)], PRINTS)
    assert {tuple(r) for r in policies.capital_return(prints).collect()} == {("A", 300, 300, 2700, 9.0), ("B", 10, 10, None, None)}


def test_policy_has_a_row_for_each_open_day(spark):
    rows = [("A", D[0], 40, 2, True, True, 0), ("A", D[0], 30, 1, False, True, 0), ("A", D[2], 50, 1, False, True, 0), ("B", D[1], 20, 1, True, False, 0), ("C", D[0], 50, 1, True, True, None), ("C", D[1], 50, 1, False, True, None)]
    roots = spark.createDataFrame([("A", "E"), ("B", "E")], "ticker string, event_ticker string")
    got = {(r.event_ticker, r.market, r.day[-2:]): tuple(r)[3:] for r in policies.policy_days(spark.createDataFrame(rows, PRINTS), roots).collect()}
    assert got == {
        ("E", None, "01"): (120, 190, -70, 2, 1, 1, 2, 1, 80), ("E", None, "02"): (-20, -20, 0, 1, 1, 1, 1, 2, 100), ("E", None, "03"): (0, 50, -50, 1, 0, 0, 0, 1, 80),
        (None, "C", "01"): (None, None, None, 1, 1, 1, 1, 1, 50), (None, "C", "02"): (0, None, None, 1, 0, 0, 0, 1, 50),
    }


def test_retreat_over_several_levels(spark):
    steps = [("snapshot", 40, 5), ("delta", 41, 5), ("delta", 42, 5), ("delta", 42, -3), ("delta", 41, -3)]
    frames = spark.createDataFrame([(1, 0, i, k, "M", "yes", p, q, i) for i, (k, p, q) in enumerate(steps, 1)], "epoch int, sid long, arrival long, kind string, ticker string, side string, price_cents int, qty long, seq long")
    got = {r.arrival: (r.yes_change, r.yes_lost, r.no_change, r.no_lost) for r in sequence.retreats(frames, 3, 2).collect()}
    assert got == {2: (5, 0, 0, 0), 3: (10, 0, 0, 0), 4: (2, 0, 0, 0), 5: (-6, 2, 0, 0)}
