import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.operators import exposure, features, fills, research, slices

T0 = dt.datetime(2024, 1, 1)


def rows(n, seed=1):
    """A market with most of the rows, some with a few, null values, and times that many rows share."""
    rng = random.Random(seed)
    market = lambda: rng.choice(("HOT",) * 6 + ("A", "B", None, f"M{rng.randrange(9)}"))
    return [(i, T0 + dt.timedelta(minutes=rng.randrange(n // 2)), market(), rng.choice((None, 40, 41, 45)), rng.choice((None, 43, 46, 60))) for i in range(n)]


SCHEMA = "event_id long, ts timestamp_ntz, ticker string, yes_bid int, yes_ask int"


@pytest.mark.parametrize("n", [1, 3, 50])
def test_like_windows(spark, n):
    df = spark.createDataFrame(rows(600), SCHEMA)
    by = ("ts", "event_id")
    w = Window.partitionBy("ticker").orderBy(*by)
    past, ahead, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.last("yes_bid", True).over(past).alias("was"), F.lag("ts").over(w).alias("ts0"), F.first("yes_ask", True).over(ahead).alias("next"), F.lead("event_id").over(w).alias("id1"), F.coalesce(F.sum("yes_bid").over(upto), F.lit(0)).alias("total"), F.min("yes_ask").over(past).alias("low"))
    got = slices.over(df, ("ticker",), by, n, before={"was": F.col("yes_bid"), "ts0": F.col("ts")}, after={"next": F.col("yes_ask"), "id1": F.col("event_id")}, sums={"total": F.col("yes_bid")}, lows={"low": F.col("yes_ask")})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert slices.over(df.limit(0), ("ticker",), by, n, before={"was": F.col("yes_bid")}).count() == 0


def test_a_hot_key_is_spread(spark):
    """No task sorts more than its slice of the hot market, whose rows are most of the table."""
    cut = slices.sliced(spark.createDataFrame(rows(4000), SCHEMA), ("ts", "event_id"), 50)
    most = cut.groupBy("ticker", slices.SLICE).count().agg(F.max("count")).first()[0]
    assert cut.where("ticker = 'HOT'").count() > 2000 and most < 4000 / 50 * 2


@pytest.mark.parametrize("n", [3, 50])
def test_operators_do_not_depend_on_slices(spark, n):
    l1 = spark.createDataFrame(rows(500), SCHEMA)
    trades = l1.selectExpr("event_id as trade_id", "ts", "ticker", "coalesce(yes_bid, 50) as price_cents", "1 as size", "event_id % 2 = 0 as taker_yes").where("trade_id % 3 = 0")
    tape = trades.selectExpr("trade_id as tape_id", "ts", "ticker", "price_cents", "size", "taker_yes")
    filled = tape.selectExpr("tape_id as cid", "tape_id", "ticker", "ts", "price_cents", "taker_yes as buy_yes", "2 as qty")
    events = l1.selectExpr("ticker", "ts", "event_id as cid", "event_id % 3 as step", "event_id as tape_id", "coalesce(yes_bid, 0) as d_risk", "1 as d")
    forms = {
        "as_of": lambda k: research.as_of(trades, l1, F.col("ts"), True, "past", k),
        "last": lambda k: research.past_and_future(trades, l1, (1, 5), "last", k),
        "first": lambda k: research.past_and_future(trades, l1, (1, 5), "first", k),
        "intervals": lambda k: research.intervals(l1, k),
        "episodes": lambda k: research.episodes(l1, 4, k),
        "transitions": lambda k: research.transitions(l1, k),
        "running": lambda k: exposure.running(events, k),
        "stepped": lambda k: features.stepped(l1, k),
        "markout": lambda k: fills.markout(filled, tape, 0, k),
    }
    for name, form in forms.items():
        assert sorted(map(str, form(1).collect())) == sorted(map(str, form(n).collect())), name


def test_past_and_future_like_plain(spark):
    l1 = rows(300, 4)
    trades = [(i, T0 + dt.timedelta(minutes=(i * 7) % 150), r[2]) for i, r in enumerate(rows(90, 6)) if r[2]]
    got = research.past_and_future(spark.createDataFrame(trades, "trade_id long, ts timestamp_ntz, ticker string"), spark.createDataFrame(l1, SCHEMA), (1,), "last", 7)
    books = sorted((r[1], r[0], r[3], r[4], r[2]) for r in l1 if r[2])
    for r in got.collect():
        own = [b for b in books if b[4] == r.ticker]
        past = [b for b in own if b[0] < r.ts]
        later = [b for b in own if r.ts < b[0] <= r.ts + dt.timedelta(hours=1)]
        assert (tuple(r.past) if r.past else None) == ((past[-1][0], past[-1][2], past[-1][3]) if past else None)
        assert (tuple(r.f1) if r.f1 else None) == ((later[-1][0], later[-1][2], later[-1][3]) if later else None)


def test_legs_at_aligned_times(spark):
    """Sums of the last asks of all legs, against a dictionary of legs stepped through update by update."""
    rng = random.Random(9)
    dim = [("A", "E1"), ("B", "E1"), ("HOT", "E1"), ("M1", "E2"), ("M2", "E2"), ("M3", None), ("M4", "E3")]
    quotes = [(i, T0 + dt.timedelta(minutes=i // 3), rng.choice([d[0] for d in dim] + ["HOT"] * 4), 1, rng.choice((None, 30, 35, 61))) for i in range(400)]
    of, last, want = dict(dim), {}, []
    for i, _, ticker, _, ask in quotes:
        event = of[ticker]
        if event:
            last.setdefault(event, {})[ticker] = ask
            asks = [a for a in last[event].values() if a is not None]
            want.append((event, i, len(asks), sum(asks)))
    frame, legs = spark.createDataFrame(quotes, SCHEMA), spark.createDataFrame(dim, "ticker string, event_ticker string")
    for n in (1, 7):
        got = features.aligned(frame, legs, n).select("event_ticker", "event_id", "quoted", "sum_ask").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    payouts = spark.createDataFrame([("E1",)], "event_ticker string")
    trades = spark.createDataFrame([(t, T0) for t in ("A", "B", "HOT", "M1")], "ticker string, ts timestamp_ntz")
    assert [(r.n > 0, r.state) for r in features.funnel(frame, legs).collect()] == [(True, "EXECUTED"), (False, "NOT_ESTIMABLE"), (False, "NOT_ESTIMABLE")]
    steps = [(r.n, r.state) for r in features.funnel(frame, legs, payouts, trades).collect()]
    assert steps == [(2, "EXECUTED"), (1, "EXECUTED"), (1, "EXECUTED")]


def test_first_in_first_out(spark):
    """Deletions end the oldest open creation of their account; those without one are void; what is open at the end is censored."""
    rng = random.Random(3)
    log = [(i, rng.choice((1, 1, 1, 2, 3)), T0 + dt.timedelta(minutes=i // 2), rng.choice(("create", "delete", "delete", "other"))) for i in range(500)]
    queues, want = {}, {}
    for i, account, ts, what in log:
        q = queues.setdefault(account, [])
        if what == "create":
            q.append(i)
            want[i] = None
        elif what == "delete" and q:
            want[q.pop(0)] = ts
    rows = spark.createDataFrame(log, "req_id long, account long, ts timestamp_ntz, what string").selectExpr("*", "case what when 'create' then 1 when 'delete' then -1 end as d")
    for n in (1, 9):
        got = features.lifetimes(rows.where("d is not null"), n).collect()
        assert {r.req_id: r.end_ts for r in got} == want
