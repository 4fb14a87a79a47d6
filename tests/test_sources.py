import json
from pathlib import Path

from pyspark.sql import functions as F

from tapewright.sources import capture, files, messages

# Values of our own; only the names of fields and kinds are the public protocol's.
WIRE = [
    {"type": "orderbook_snapshot", "sid": 6, "seq": 41, "msg": {"market_ticker": "RAIN-7", "yes_dollars_fp": [["0.3100", "12.00"], ["0.4400", "?"], ["0.2", "7", "third"]], "no_dollars_fp": []}},
    {"type": "orderbook_delta", "sid": 6, "seq": 42, "msg": {"market_ticker": "RAIN-7", "price_dollars": "0.170", "delta_fp": "-2.50", "side": "yes", "client_order_id": "mine-9", "ts_ms": 1700000000123}},
    {"type": "orderbook_delta", "sid": 6, "seq": 43, "msg": {"market_ticker": "RAIN-7", "price_dollars": "0.17003", "delta_fp": "-2.50", "side": "yes"}},
    {"type": "ticker", "sid": 8, "msg": {"market_ticker": "RAIN-7", "last_price_dollars": "0.620", "yes_bid_dollars": "0.610", "yes_ask_dollars": "0.640", "volume_fp": "905.25"}},
    {"type": "trade", "sid": 8, "msg": {"market_ticker": "RAIN-7", "yes_price_dollars": "0.7300", "count_fp": "19.00", "taker_outcome_side": "no", "trade_id": "q-1"}},
    {"type": "trade", "sid": 8, "msg": {"market_ticker": "RAIN-7", "yes_price_dollars": "none", "no_price_dollars": "0.1100", "count_fp": "3"}},
    {"type": "trade", "sid": 8, "msg": {"market_ticker": "RAIN-7", "yes_price_dollars": "none", "count_fp": "3"}},
    {"type": "market_lifecycle_v2", "sid": 9, "msg": {"market_ticker": "RAIN-7", "event_type": "determined", "settlement_value": "0.0000"}},
    {"type": "market_lifecycle_v2", "sid": 9, "msg": {"market_ticker": "RAIN-7", "event_type": "folded"}},
    {"type": "error", "msg": {"code": 25}}, {"type": "greeting", "msg": {}},
]
HOSTILE = ["", "{", "[]", "5", "null", '"x"', '{"type":5}', '{"type":"orderbook_delta"}', '{"type":"orderbook_delta","msg":[1]}', '{"type":"trade","msg":{"market_ticker":{}}}', '{"type":"orderbook_snapshot","msg":{"yes_dollars_fp":"x"}}', "\x00\x01", '{"type":"orderbook_snapshot","msg":{"yes_dollars_fp":[[],[1],[null,null],"q"]}}']


def test_messages_of_each_kind(spark):
    d = messages.decoded(spark.createDataFrame([(json.dumps(m),) for m in WIRE], "raw string")).cache()
    s = messages.snapshots(d).first()
    assert [(x.price, x["size"]) for x in s.yes] == [(3100, 1200)] and s.no == []
    x = messages.deltas(d).collect()
    assert [(r.price, r.delta, r.side, r.client_order_id, r.m.msg.ts_ms) for r in x] == [(1700, -250, "yes", "mine-9", 1700000000123)]
    t = messages.tickers(d).first()
    assert (t["last"], t.bid, t.ask, t.volume) == (6200, 6100, 6400, 90525)
    assert [(r.price, r.size, r.taker, r.price_ok) for r in messages.trades(d).select("price", F.col("size").alias("size"), "taker", "price_ok").collect()] == [(7300, 1900, "no", True), (8900, 300, "yes", True), (0, 300, "yes", False)]
    assert [(r.state, r.settlement, r.unknown_type) for r in messages.lifecycles(d).collect()] == [("Determined", 0, None), ("Unknown", None, "folded")]
    e = messages.error_counts(d).first()
    assert (e.errors, e.overflows) == (1, 1)


def test_hostile_messages(spark):
    d = messages.decoded(spark.createDataFrame([(h,) for h in HOSTILE], "raw string"))
    assert messages.deltas(d).count() == messages.lifecycles(d).count() == 0
    assert all(not r.yes and not r.no for r in messages.snapshots(d).collect())
    assert all(not r.price_ok for r in messages.trades(d).collect())


def test_capture_log(spark, tmp_path):
    rec = lambda i, **k: json.dumps({"recv_mono_ns": i, "recv_wall_ns": i, "source": "ws", "channel": "c", "sid": 1, **k})
    (tmp_path / "log").write_text("\n".join([rec(1, source_sequence=1, raw='{"a":1}'), "", rec(2, marker="gap"), "not json", "[1]", rec(3, raw_b64="/wA="), rec(4, marker="loss", source_sequence=7), '{"recv_mono_ns": 5, "raw": "cut o']))
    (tmp_path / "log.2").write_text(rec(9, raw="é") + "\n")
    r = capture.scan(spark, str(tmp_path)).cache()
    c = capture.counts(r).first()
    assert (c.recorded, c.markers, c.corrupt, c.lost, c.verdict) == (3, 2, 3, 7, "LOSSY")
    assert sorted((x.recv_mono_ns, bytes(x.payload), x.rotation) for x in capture.data(r).collect()) == [(1, b'{"a":1}', 0), (3, b"\xff\x00", 0), (9, "é".encode(), 2)]
    assert capture.markers(r).count() == 2
    out = str(tmp_path / "copy")
    capture.write(capture.data(r).select("recv_mono_ns", "source", "payload"), out)
    again = capture.data(capture.scan(spark, out)).collect()
    assert sorted(bytes(x.payload) for x in again) == sorted([b'{"a":1}', b"\xff\x00", "é".encode()])


def test_small_files(spark, tmp_path):
    (tmp_path / "tape").write_text('{"t":"trade","ts":5,"tk":"A","fam":"F","p":40,"c":2,"y":1}\n{"t":"trade","tk":"B"}\n{"t":"other","tk":"A"}\n{"ts":1}\nx\n{"t":"settle","ts":9,"tk":"A","yes":1}\n')
    trades, settles = files.tape(spark, str(tmp_path / "tape"))
    assert sorted(map(tuple, trades.collect())) == [(0, "B", "", 0, 0, False), (5, "A", "F", 40, 2, True)]
    assert settles.first().yes_wins
    (tmp_path / "fees").write_text("# c\n\nKA-,175,700,src,1\nKB,x,1\nKC,12x,3\nKD,1\n")
    assert [(r.series_prefix, r.maker_rate_e4, r.taker_rate_e4) for r in files.fees(spark, str(tmp_path / "fees")).orderBy("pos").collect()] == [("KA-", 175, 700), ("KC", 12, 3)]
    (tmp_path / "m").write_text(json.dumps({"markets": [{"ticker": "T", "status": "open", "yes_bid_dollars": "0.4", "yes_ask_dollars": None, "last_price_dollars": "0.5", "volume_fp": "3.00", "open_interest_fp": "1"}], "cursor": "x"}))
    m = files.markets(spark, str(tmp_path / "m")).first()
    assert (m.ticker, m.bid, m.ask, m.volume) == ("T", 4000, None, 300)
    for name, page in (("b1", {"orderbook_fp": {"yes_dollars": [["0.5", "2"], ["0.4", "1"]], "no_dollars": []}}), ("b2", {"orderbook": {"yes": [[5, 2]], "no": [[9, 1], [3, 1]]}}), ("b3", {})):
        (tmp_path / name).write_text(json.dumps(page))
    b = {n: files.books(spark, str(tmp_path / n)).first() for n in ("b1", "b2", "b3")}
    assert [x.price for x in b["b1"].yes] == [4000, 5000] and [(x.price, x["size"]) for x in b["b2"].no] == [(300, 100), (900, 100)] and b["b3"].yes == []
    (tmp_path / "l").write_text(json.dumps({"usage_tier": "prime", "read": {"refill_rate": 1, "bucket_capacity": 2}}))
    x = files.limits(spark, str(tmp_path / "l")).first()
    assert (x.tier, x.read_refill, x.write_refill, x.from_server) == ("basic", 200, 100, False)
    (tmp_path / "o").write_text('{"type":"order","ts_ms":2,"extra":[1]}\n{bad\n{"type":"feed","ts_ms":5}\n')
    assert [r.type for r in files.last_lines(spark, str(tmp_path / "o"), 1).collect()] == ["feed"]


def test_pages_share_files(spark, tmp_path):
    """Pages that a query saves are lines of as many files as tasks wrote them, not a file each."""
    from tapewright.plans import files as plans
    from tapewright.sources import scratch

    spark.range(90).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey").coalesce(2).write.parquet(str(tmp_path / "supplier.parquet"))
    got = plans.file_limits(spark, str(tmp_path))
    path = next(p for p in reversed(scratch._placed) if "/limits-" in p).removeprefix("file://")
    assert len(list(Path(path.removeprefix("file:")).glob("part-*"))) <= 2
    assert sum(r.n for r in got.collect()) == 90 and {r.n for r in got.where("not from_server").collect()} == {30}
