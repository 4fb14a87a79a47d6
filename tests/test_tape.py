import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import exposure, fills, quotes
from tapewright.operators.order import numbered

DAY = dt.datetime(2020, 1, 1)
TAPE = "ticker string, tape_id long, price_cents int, size int, taker_yes boolean, ts timestamp_ntz"
QUOTES = "cid long, ticker string, price_cents int, count int, buy_yes boolean, place_ts timestamp_ntz, queue_ahead long, cancel_ts timestamp_ntz"


def day(n):
    return DAY + dt.timedelta(days=n)


def tape(spark, rows):
    return spark.createDataFrame([("KA-1", i + 1, p, n, y, day(d)) for i, (d, p, n, y) in enumerate(rows)], TAPE)


def quote(spark, price=40, count=10, buy=True, place=0, ahead=0, cancel=None):
    return spark.createDataFrame([(1, "KA-1", price, count, buy, day(place), ahead, None if cancel is None else day(cancel))], QUOTES)


def total(df):
    return sum(r.qty for r in df.collect())


def test_queue_drains_first(spark):
    met = fills.eligible(tape(spark, [(1, 40, 60, False), (2, 40, 40, False), (3, 40, 25, False)]), quote(spark, ahead=100)).cache()
    got = fills.fills(met, "queue").collect()
    assert [(r.tape_id, r.qty) for r in got] == [(3, 10)]
    rates = spark.createDataFrame([("KA-1", 175)], "ticker string, maker_rate_e4 int")
    ledger = fills.market_ledger(fills.fills(met, "queue"), rates)
    r = fills.family_report(spark.createDataFrame([("KA-1", "KA")], "ticker string, family string"), ledger, spark.createDataFrame([("KA-1", False)], "ticker string, yes_wins boolean"), rates).first()
    assert (r.gross_pnl_cents, r.fee_cents, r.net_pnl_cents) == (-400, 5, -405)


def test_strict_needs_a_print_through(spark):
    assert total(fills.fills(fills.eligible(tape(spark, [(1, 40, 50, False)]), quote(spark)), "strict")) == 0
    assert total(fills.fills(fills.eligible(tape(spark, [(1, 40, 50, False), (2, 39, 50, False)]), quote(spark)), "strict")) == 10


@pytest.mark.parametrize("prints,want", [([1], 0), ([1, 2], 1), ([1, 2, 3], 2), ([1, 2, 3, 4], 2)])
def test_latency_of_placement_and_cancel(spark, prints, want):
    met = fills.eligible(tape(spark, [(d, 39, 1, False) for d in prints]), quote(spark, place=1, cancel=3), 1)
    assert total(fills.fills(met, "strict")) == want


def test_unknown_fee_stays_out_of_net(spark):
    fees = spark.createDataFrame([("KA-", 175, 700, 1), ("KA-1", -1, -1, 2)], "series_prefix string, maker_rate_e4 int, taker_rate_e4 int, pos int")
    t = tape(spark, [(1, 39, 50, False)])
    rates = fills.fee_rates(t, fees)
    assert rates.first().maker_rate_e4 is None
    ledger = fills.market_ledger(fills.fills(fills.eligible(t, quote(spark)), "strict"), rates)
    r = fills.family_report(spark.createDataFrame([("KA-1", "KA")], "ticker string, family string"), ledger, spark.createDataFrame([("KA-1", True)], "ticker string, yes_wins boolean"), rates).first()
    assert (r.gross_pnl_cents, r.net_pnl_cents, r.excluded_fee_unknown) == (600, 0, 1)


def loop(prints, q, track):
    """One print at a time."""
    left, ahead, out = q["count"], q["ahead"], []
    if track == "queue" and ahead is None:
        return out
    for i, (d, p, n, yes) in enumerate(prints, 1):
        if d < q["place"] or (q["cancel"] is not None and d >= q["cancel"]):
            continue
        if not ((not yes and p <= q["price"]) if q["buy"] else (yes and p >= q["price"])):
            continue
        avail = n
        if track == "strict" and p == q["price"]:
            avail = 0
        if track == "queue":
            if p == q["price"]:
                drained = min(avail, ahead)
                ahead, avail = ahead - drained, avail - drained
            elif ahead:
                avail = 0
        qty = min(avail, left)
        if qty > 0:
            out.append((i, qty))
            left -= qty
    return out


def test_tracks_like_a_loop(spark):
    rng = random.Random(8)
    prints = sorted(((rng.randrange(60), rng.randrange(35, 46), rng.randrange(1, 9), rng.random() < 0.5) for _ in range(400)), key=lambda x: x[0])
    qs = [{"price": rng.randrange(36, 45), "count": rng.randrange(1, 60), "buy": rng.random() < 0.5, "place": rng.randrange(40), "ahead": rng.choice([None, 0, 5, 30]), "cancel": rng.choice([None, 20, 45, 59])} for _ in range(40)]
    q = spark.createDataFrame([(i, "KA-1", x["price"], x["count"], x["buy"], day(x["place"]), x["ahead"], None if x["cancel"] is None else day(x["cancel"])) for i, x in enumerate(qs)], QUOTES)
    met = fills.eligible(tape(spark, prints), q).cache()
    got = {t: sorted((r.cid, r.tape_id, r.qty) for r in fills.fills(met, t).collect()) for t in fills.TRACKS}
    for t in fills.TRACKS:
        assert got[t] == sorted((i, k, n) for i, x in enumerate(qs) for k, n in loop(prints, x, t))
    for block, slices in ((1, 1), (5, 3), (64, None)):
        walked = fills.tracked(tape(spark, prints), fills.orders(q, fills.TRACKS, (0, 2)), block, slices).collect()
        for t in fills.TRACKS:
            assert sorted((r.cid, r.tape_id, r.qty) for r in walked if r.track == t and r.latency_days == 0) == got[t]
    for t in fills.TRACKS:
        late = fills.fills(fills.eligible(tape(spark, prints), q, 2), t).collect()
        assert sorted((r.cid, r.tape_id, r.qty) for r in walked if r.track == t and r.latency_days == 2) == sorted((r.cid, r.tape_id, r.qty) for r in late)
    again = fills.fills(fills.eligible(tape(spark, prints).repartition(5), q.repartition(3)), "queue").collect()
    assert sorted((r.cid, r.tape_id, r.qty) for r in again) == got["queue"]


def sequential(price, size, yes, at_s, q, track):
    """The fills of one quote against all prints, by running sums."""
    inside = (at_s >= q["place"]) & ((q["cancel"] is None) | (at_s < (q["cancel"] or 0)))
    met = np.flatnonzero(inside & ((~yes & (price <= q["price"])) if q["buy"] else (yes & (price >= q["price"]))))
    n, at = size[met], price[met] == q["price"]
    if track == "strict":
        n = np.where(at, 0, n)
    if track == "queue":
        if q["ahead"] is None:
            return []
        rest = np.maximum(0, q["ahead"] - (np.cumsum(n * at) - n * at))
        n = np.where(at, np.maximum(0, n - rest), np.where(rest == 0, n, 0))
    so_far = np.cumsum(n)
    qty = np.minimum(so_far, q["count"]) - np.minimum(so_far - n, q["count"])
    return [(int(met[i]) + 1, int(qty[i])) for i in np.flatnonzero(qty)]


def test_a_dense_market_day(spark):
    """100000 prints and 10000 quotes in one market and day: no order meets more than its blocks."""
    rng = np.random.default_rng(4)
    n, m = 100_000, 10_000
    at_s = np.sort(rng.integers(0, 86_400, n))
    price, size, yes = 50 + rng.integers(-6, 7, n), rng.integers(1, 9, n), rng.random(n) < 0.5
    t = spark.createDataFrame(pd.DataFrame({"ticker": "KA-1", "tape_id": np.arange(1, n + 1), "price_cents": price.astype("int32"), "size": size.astype("int32"), "taker_yes": yes, "ts": pd.Timestamp(DAY) + pd.to_timedelta(at_s, unit="s")}), TAPE)
    qs = [{"price": int(rng.integers(42, 59)), "count": int(rng.integers(1, 60)), "buy": bool(rng.random() < 0.5), "place": int(rng.integers(0, 80_000)), "ahead": None if rng.random() < 0.1 else int(rng.integers(0, 400)), "cancel": None} for _ in range(m)]
    for q in qs[::3]:
        q["cancel"] = q["place"] + int(rng.integers(1, 20_000))
    second = lambda x: DAY + dt.timedelta(seconds=x)
    quotes_ = spark.createDataFrame([(i, "KA-1", q["price"], q["count"], q["buy"], second(q["place"]), q["ahead"], None if q["cancel"] is None else second(q["cancel"])) for i, q in enumerate(qs)], QUOTES)
    got = fills.tracked(t, fills.orders(quotes_, fills.TRACKS)).select("cid", "track", "tape_id", "qty").toPandas()
    by = {k: sorted(zip(g["tape_id"].tolist(), g["qty"].tolist(), strict=True)) for k, g in got.groupby(["cid", "track"])}
    for i in range(0, m, 29):
        for track in fills.TRACKS:
            assert by.get((i, track), []) == sequential(price, size, yes, at_s, qs[i], track), (i, track)
    assert len(got) > 3 * m


def test_convergence_loses(spark):
    t = tape(spark, [(i, 90 + i * 9 // 29, 20, True) for i in range(30)])
    q = spark.createDataFrame([(i, "KA-1", 92 + i % 5, 10, False, day(0), 0, None) for i in range(10)], QUOTES)
    rates = spark.createDataFrame([("KA-1", 175)], "ticker string, maker_rate_e4 int")
    net = {}
    for track in ("strict", "optimistic"):
        ledger = fills.market_ledger(fills.fills(fills.eligible(t, q), track), rates)
        net[track] = fills.family_report(spark.createDataFrame([("KA-1", "K")], "ticker string, family string"), ledger, spark.createDataFrame([("KA-1", True)], "ticker string, yes_wins boolean"), rates).first().net_pnl_cents
    assert net["strict"] < 0 and net["optimistic"] <= net["strict"]


def test_markout(spark):
    t = tape(spark, [(1, 39, 5, False), (3, 50, 1, True), (9, 30, 1, True)])
    f = fills.fills(fills.eligible(t, quote(spark, count=5)), "strict")
    r = {x.tape_id: x for x in fills.markout(f, t, 2).collect()}
    assert r[1].ref_cents == 50 and r[1].markout_cents == 50


def test_exposure(spark):
    q, t = quote(spark, cancel=9), tape(spark, [(1, 39, 4, False), (2, 39, 50, False)])
    e = exposure.running(exposure.lifecycle(q, fills.fills(fills.eligible(t, q), "strict"))).orderBy("ts", "step").collect()
    assert [(x.event, x.at_risk_cents) for x in e] == [("open", 400), ("fill", 240), ("fill", 0)]


STEPS = "cid long, at timestamp_ntz, rank int, state string"


def test_seven_states(spark):
    """Latency of two days: filled, canceled while the fill is pending, canceled before it opened, expired by settlement before and after it opened, ineligible."""
    orders = [
        (1, 4, day(0), None, 2, False, None), (2, 9, day(0), day(5), 2, False, None), (3, 9, day(0), day(1), 2, False, None), (4, 9, day(0), None, 2, False, day(6)),
        (5, 9, day(5), None, 2, False, day(6)), (6, 9, day(0), None, 2, True, None), (7, 9, day(0), day(5), 2, False, day(6)), (8, 4, day(0), day(5), 2, False, None),
    ]
    o = spark.createDataFrame(orders, "cid long, count int, place_ts timestamp_ntz, cancel_ts timestamp_ntz, latency_days int, ineligible boolean, settle_ts timestamp_ntz")
    done = [(1, 3, day(3), 1), (1, 1, day(4), 2), (2, 5, day(3), 1), (8, 4, day(6), 5)]
    log = exposure.states(o, spark.createDataFrame(done, "cid long, qty long, ts timestamp_ntz, tape_id long"))
    got = {}
    for r in log.orderBy("cid", "at", "rank").collect():
        got.setdefault(r.cid, []).append(((r["at"] - DAY).days, r.state))
    new = [(0, "PendingNew"), (2, "Open")]
    assert got == {
        1: [*new, (4, "Filled")], 2: [*new, (5, "PendingCancel"), (7, "Canceled")], 3: [*new, (2, "PendingCancel"), (3, "Canceled")], 4: [*new, (6, "Expired")],
        5: [(5, "PendingNew"), (7, "Open")], 6: [*new, (2, "Expired")], 7: [*new, (5, "PendingCancel"), (6, "Canceled")], 8: [*new, (5, "PendingCancel"), (6, "Filled")],
    }
    assert not exposure.audit(log).where("illegal").count()
    bad = [(1, day(9), 0, "Filled"), (5, day(8), 0, "Canceled"), (9, day(0), 0, "Open")]
    found = exposure.audit(log.union(spark.createDataFrame(bad, STEPS))).where("illegal").select("was", "state", "n").collect()
    assert sorted(map(tuple, found)) == [("Filled", "Filled", 1), ("Free", "Open", 1), ("Open", "Canceled", 1)]


def test_settlement_ends_quotes(spark):
    """A settlement ends a quote that is active, and leaves one that is not."""
    t = tape(spark, [(d, 39, 1, False) for d in range(8)])
    settles = spark.createDataFrame([("KA-1", day(3))], "ticker string, settle_ts timestamp_ntz")
    for latency, want in ((0, [1, 2, 3]), (2, [3]), (4, [5, 6, 7, 8])):
        got = fills.tracked(t, fills.orders(quote(spark), ("strict",), (latency,), settles)).collect()
        assert sorted(r.tape_id for r in got) == want


def test_quotes(spark):
    t = tape(spark, [(0, 50, 1, True), (1, 50, 1, True), (2, 99, 1, True), (3, 51, 1, True)])
    got = sorted((r.side, r.tape_id, r.price_cents, r.until_tape_id) for r in quotes.from_tape(t, 2).collect())
    assert got == [("ask", 1, 52, 4), ("ask", 4, 53, None), ("bid", 1, 48, 3), ("bid", 3, 97, 4), ("bid", 4, 49, None)]
    capped = quotes.with_cap(t.select("ticker", "tape_id", "price_cents", "size", "taker_yes"), 2, 10, 1).first()
    assert capped.placed > 0 and capped.sold >= 1


def test_an_order_and_its_block_are_one_row(spark):
    """200 orders and 64 prints that all cross: what is shuffled and written is a row for each order, not one for each pair."""
    q = spark.createDataFrame([(i, "KA-1", 60, 1 + i % 90, True, day(0), 0, None) for i in range(200)], QUOTES)
    prints = fills.numbered_sides(tape(spark, [(1 + k % 5, 40, 1, False) for k in range(64)]))
    open_ = fills.orders(q, ("strict",)).selectExpr(*fills.ORDER, "ticker", "not buy_yes as taker_yes", "price_cents", "buy_yes", "60 as level", "59 as p", "cast(count as bigint) as left", "0L as ahead", "place_ts as from_ts", "timestamp_ntz'2100-01-01 00:00:00' as until_ts")
    o = fills.living(prints, open_).withColumn("block", F.floor(F.col("lo") / fills.BLOCK)).withColumn("last", F.col("block"))
    got = fills.walked(o, fills.rows_of_blocks(prints)).collect()
    assert len(got) == 200
    for r in got:
        assert len(r.taken) == min(64, 1 + r.cid % 90) and r.left == max(0, 1 + r.cid % 90 - 64)


def test_the_order_of_the_tape_is_not_written(spark, tmp_path):
    """Columns that only order the tape are dropped before rows are written."""
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, s string")
    got = numbered(df, "tape_id", "n", then=lambda rows: rows.select(F.upper("s").alias("t"), "_at"))
    assert got.columns == ["t", "tape_id"] and sorted(map(tuple, got.collect())) == [("A", 1), ("B", 2), ("C", 3)]
