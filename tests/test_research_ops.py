import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import order, research, sequence, signals
from tapewright.sources import scratch
from tapewright.streaming import streams

T0 = dt.datetime(2024, 1, 1)
L1 = "event_id long, ts timestamp_ntz, ticker string, yes_bid int, yes_ask int"
TR = "trade_id long, ts timestamp_ntz, ticker string, price_cents int, size int, taker_yes boolean"


def hour(h):
    return T0 + dt.timedelta(hours=h)


def test_numbered_is_total_and_stable(spark):
    rows = [(i * 7 % 50, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int")
    for d in (df, df.repartition(9)):
        got = order.numbered(d, "n", "a", "b").orderBy("n").collect()
        assert [r.n for r in got] == list(range(1, 301)) and [(r.a, r.b) for r in got] == sorted(rows)
    assert order.numbered(df.limit(0), "n", "a").count() == 0


def test_as_of_is_strict(spark):
    book = spark.createDataFrame([(1, hour(1), "A", 40, 42), (2, hour(3), "A", 50, 52), (3, hour(3), "B", 1, 2)], L1)
    tr = spark.createDataFrame([(9, hour(3), "A", 45, 1, True), (10, hour(4), "A", 45, 1, True), (11, hour(0), "A", 45, 1, True)], TR)
    got = {r.trade_id: r.past for r in research.as_of(tr, book, F.col("ts"), True, "past").collect()}
    assert got[9].bid == 40 and got[10].bid == 50 and got[11] is None
    f = {r.trade_id: r for r in research.past_and_future(tr, book, (1, 4), "first").collect()}
    assert f[11].f1.bid == 40 and f[9].f4 is None
    g = {r.trade_id: r for r in research.past_and_future(tr, book, (1, 4), "last").collect()}
    assert g[11].f4.bid == 50 and g[9].f1 is None


def test_gaps(spark):
    gaps = spark.createDataFrame([(hour(5), hour(6))], "gap_start timestamp_ntz, gap_end timestamp_ntz")
    rows = spark.createDataFrame([(1, hour(1), hour(5)), (2, hour(5), hour(7)), (3, hour(1), hour(200)), (4, hour(6), hour(9))], "trade_id long, s timestamp_ntz, e timestamp_ntz")
    assert sorted(r.trade_id for r in research.clear_of_gaps(rows, gaps, "s", "e").collect()) == [1, 4]


def test_dwell_and_states(spark):
    l1 = spark.createDataFrame([(1, hour(0), "A", 40, 42), (2, hour(1), "A", None, 42), (3, hour(9), "A", None, None), (4, hour(10), "A", 50, 49)], L1)
    got = {(r.ttl_min, r.reason): (r.n, r.dwell_us) for r in research.dwell(l1, (120,)).collect()}
    assert got == {(120, research.OBSERVED): (1, 3_600_000_000), (120, research.STALE): (1, 7_200_000_000), (120, research.LAST): (1, 0)}
    assert [r.state for r in research.intervals(l1).orderBy("event_id").collect()] == ["TWO_SIDED", "ASK_ONLY", "NONE", "CROSSED"]


def test_hazard_matches_published_arithmetic(spark):
    eps = spark.createDataFrame([("A", hour(0), hour(0), hour(i)) for i in (1, 1, 2, 5)] + [("A", hour(0), hour(2), None)], "ticker string, start_ts timestamp_ntz, last_ts timestamp_ntz, refill_ts timestamp_ntz")
    h = {r.bin: (r.at_risk, r.events) for r in research.hazard(eps, 4, 60).collect()}
    assert h == {0: (5, 0), 1: (5, 2), 2: (3, 1), 3: (1, 0)}
    s = {r.bin: r.refilled for r in research.survival(research.hazard(eps, 4, 60)).collect()}
    assert math.isclose(s[3], 1 - 3 / 5 * 2 / 3, abs_tol=1e-6)


def test_matching_is_one_to_one(spark):
    eps = spark.createDataFrame([("A", 10 + i, hour(5 + i), 40, 44) for i in range(3)], "ticker string, first_id long, start_ts timestamp_ntz, bid0 int, ask0 int")
    ctl = spark.createDataFrame([(1, hour(4), "B", 40, 42), (2, hour(1), "B", 41, 42)], L1)
    got = research.matched(eps, ctl, 24, 24).collect()
    assert [(r.episode, r.control) for r in got] == [(10, 1)]


def test_cusum(spark):
    rows = [("A", i, hour(i), 100.0 if i < 20 else 140.0) for i in range(40)]
    got = signals.cusum(spark.createDataFrame(rows, "ticker string, event_id long, ts timestamp_ntz, mid double"), 30.0, 1.0, 0.1).where("change_point").collect()
    assert [r.event_id for r in got] == [20]


def test_walked(spark):
    lv = spark.createDataFrame([(0, "A", 40, 5), (0, "A", 42, 3)], "sid long, ticker string, price_cents int, size long")
    r = signals.walked(lv, 6).first()
    assert (r.filled, r.proceeds, r.best) == (6, 3 * 42 + 3 * 40, 42)


FRAMES = "epoch int, sid long, arrival long, kind string, ticker string, side string, price_cents int, qty long, seq long, ts timestamp"


def random_frames(seed, n):
    """Frames of three streams with gaps, numbers that come again, snapshots, and books that fall below zero."""
    rng, seqs, rows = random.Random(seed), [0, 0, 0], []
    for i in range(1, n + 1):
        sid = rng.choice((0, 0, 0, 1, 2))
        seqs[sid] += rng.choice((1, 1, 1, 1, 1, 1, 3, 0))
        kind = rng.choice(("snapshot", "delta", "delta", "delta", "delta", "delta", "delta", "control"))
        rows.append((1, sid, i, kind, f"M{sid}{rng.randrange(2)}", rng.choice(("yes", "no")), 40 + rng.randrange(3), rng.choice((5, 3, 1, -1, -4)), seqs[sid], hour(i // 2)))
    return rows


def laddered(rows, rung_s, rungs=3):
    """The ladder stepped through frame by frame, books and all."""
    streams_, out = {}, []
    for _, sid, arrival, kind, ticker, side, price, qty, seq, ts in rows:
        s = streams_.setdefault(sid, {"last": None, "books": {}, "open": None, "clock": ts})
        s["clock"] = max(s["clock"], ts)
        passed = (s["clock"] - s["open"][1]).total_seconds() if s["open"] else 0
        if s["open"] and passed >= rungs * rung_s:
            out.append((sid, s["open"][0], rungs, False, rungs * rung_s * 1_000_000, s["open"][2]))
            s["open"] = None
        ahead, stale = s["last"] is not None and seq > s["last"] + 1, s["last"] is not None and seq <= s["last"]
        s["last"] = seq if s["last"] is None else max(s["last"], seq)
        ask = ahead and kind != "snapshot"
        if kind == "snapshot":
            s["books"][ticker] = {(side, price): qty} if qty > 0 else {}
            if s["open"]:
                out.append((sid, s["open"][0], int(passed // rung_s), True, int(passed * 1_000_000), s["open"][2]))
                s["open"] = None
        elif ask:
            s["books"] = {}
        elif kind == "delta" and not stale and ticker in s["books"]:
            book = s["books"][ticker]
            book[side, price] = book.get((side, price), 0) + qty
            if book[side, price] < 0:
                del s["books"][ticker]
                ask = True
        if ask and s["open"]:
            s["open"][2] += 1
        elif ask:
            s["open"] = [arrival, s["clock"], 0]
    out += [(sid, s["open"][0], rungs, False, rungs * rung_s * 1_000_000, s["open"][2]) for sid, s in streams_.items() if s["open"]]
    return sorted(out)


def test_recoveries_like_a_ladder(spark):
    rows = random_frames(3, 700)
    got = sequence.recoveries(spark.createDataFrame(rows, FRAMES), 2 * 3600)
    want = laddered(rows, 2 * 3600)
    assert sorted((r.sid, r.asked, r.rung, r.recovered, r.waited_us, r.more) for r in got.collect()) == want
    assert {w[2] for w in want} == {0, 1, 2, 3} and any(w[5] for w in want)
    assert sequence.recoveries(spark.createDataFrame([], FRAMES), 60).count() == 0


@pytest.mark.parametrize(("files", "a_batch"), [(4, 100), (8, 4), (6, 2), (8, 1)])
def test_streams_lose_no_rows(spark, files, a_batch):
    """Over 1, 2, 3 and 8 batches, whose files come in no order: frames and episodes are those of the batch forms."""
    rows = random_frames(5, 240)
    frames = streams.numbered(spark.createDataFrame(rows, FRAMES), "epoch", "sid").withColumn("at", F.xxhash64("arrival"))
    end = spark.createDataFrame([(-1, -1, 0, "", "", "", 0, 0, 0, hour(9000), 1, 0)], frames.schema)
    stream = lambda: streams.replayed(frames, "at", "t", files, a_batch, end)
    got = streams.drained(streams.sequence_monitor(stream(), "90 days"), "append", "t").where("sid >= 0")
    want = sequence.classified(frames).select("sid", "arrival", "seq_class")
    assert sorted(map(tuple, got.select("sid", "arrival", "seq_class").collect())) == sorted(map(tuple, want.collect()))
    if a_batch in (1, 100):
        got = streams.drained(streams.recovery_monitor(stream(), 2 * 3600, delay="90 days"), "append", "t").where("sid >= 0").drop("epoch")
        assert sorted(map(tuple, got.collect())) == laddered(rows, 2 * 3600)
        book = streams.drained(streams.book_monitor(stream(), "90 days"), "append", "t").where("sid >= 0")
        valid = sequence.labelled(frames).where("label in ('snapshot', 'applied')")
        assert book.where("valid").join(valid, "arrival").count() == valid.count() and book.count() == len(rows)


def test_state_holds_the_disorder_only(spark):
    """In order nothing waits; a number that never comes is given up after the bound, and comes out as Late if it comes after all."""
    rows = [(1, 0, i, "delta", "M", "yes", 40, 1, i, hour(i)) for i in range(1, 61)]
    frames = streams.numbered(spark.createDataFrame(rows, FRAMES), "epoch", "sid")

    def run(name, *parts):
        path = scratch.place(spark, "log")  # files one after the other, as a recorder writes them
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(path)
        query = streams.sequence_monitor(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(path), "1 hour", 5 * 3600)
        q = query.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch.place(spark, "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
        return {r.arrival: r.seq_class for r in spark.table(name).collect()}, kept, dropped

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    tens = [frames.where(f"nth <> 20 and nth > {k} and nth <= {k + 10}") for k in range(0, 60, 10)]
    comes = frames.where("nth = 20").withColumn("ts", F.lit(hour(60)))
    got, kept, dropped = run("lost", *tens, comes)
    assert len(got) == 60 and got[20] == "Late" and got[21] == "Gap" and not dropped
    assert max(kept) < 20  # progress, state, timers, and what waited for number 20 until the bound: never the stream
    got, kept, _ = run("whole", *[frames.where(f"nth > {k} and nth <= {k + 10}") for k in range(0, 60, 10)])
    assert set(got.values()) == {"First", "Ok"} and max(kept) <= 4


def test_heartbeats_and_trades(spark):
    """Files come in no order; the last row of all closes the log."""
    beats = spark.createDataFrame([(7, 1, hour(0)), (7, 2, hour(1)), (7, 3, hour(5)), (7, 4, hour(20))], "source long, arrival long, ts timestamp")
    beats = streams.numbered(beats, "source").withColumn("at", -F.col("arrival"))
    end = spark.createDataFrame([(-1, 0, hour(1000), 1, 0)], beats.schema)
    seen = streams.drained(streams.heartbeat_monitor(streams.replayed(beats, "at", "t", 4, 1, end), 2 * 3600, 6 * 3600, "30 days"), "append", "t").where("source = 7").orderBy("at_us").collect()
    assert [(r.health, (r.at_us - seen[0].at_us) // 3_600_000_000) for r in seen] == [("ok", 0), ("lagging", 3), ("ok", 5), ("lagging", 7), ("stale", 11), ("ok", 20), ("lagging", 22), ("stale", 26)]
    tr = spark.createDataFrame([(1, hour(0), "A"), (1, hour(0), "A"), (2, hour(1), "A")], "trade_id long, ts timestamp, ticker string")
    assert streams.drained(streams.deduped(streams.source(tr, "t"), "1 day"), "append", "t").count() == 2


def test_rows_ahead_of_their_turn_wait_in_blocks():
    """Rows that come before their turn cost state one access for a block, and come out in order whatever batches they come in."""

    class Values:
        def __init__(self):
            self.kept, self.calls = {}, 0

        def get(self):
            return self.kept.get(0)

        def update(self, v):
            self.kept[0] = v

        def updateValue(self, k, v):
            self.calls += 1
            self.kept[k] = v

        def getValue(self, k):
            self.calls += 1
            return self.kept[k]

        def containsKey(self, k):
            return k in self.kept

        def removeKey(self, k):
            del self.kept[k]

    class Handle:
        def __init__(self):
            self.made = {}

        def getMapState(self, name, *_):
            return self.made.setdefault(name, Values())

        getValueState = getMapState

        def registerTimer(self, at):
            pass

    n = 40_000
    rows = [(i, i, i, i) for i in range(1, n + 1)]
    for batches in ([rows[n // 2 :], rows[: n // 2]], [rows[1::2], rows[::2]], [rows[k::7] for k in range(6, -1, -1)], [rows[9:], rows[5:9], rows[:5] + rows[2:4]]):
        p, handle, out = streams._Sequence(), Handle(), []
        p.bound_us = 10**9
        p.init(handle)
        for batch in batches:
            out += p._advanced((1, 0), sorted(batch, key=lambda r: r[0]), 0)
        ok = [o for o in out if o[2] != "Late"]
        assert [o[0] for o in ok] == list(range(1, n + 1)) and {o[2] for o in ok[1:]} == {"Ok"}
        assert len(out) - n == (2 if len(batches) == 3 else 0) and not handle.made["waiting"].kept
        assert handle.made["waiting"].calls < 100
    p.init(handle := Handle())
    assert p._advanced((1, 0), [(5, 5, 5, 5)], 0) == [] and p._advanced((1, 0), [(9, 9, 9, 9)], 0) == []
    assert [o[2] for o in p._advanced((1, 0), [], 10**10)] == ["First", "Gap"]  # given up: both come out
