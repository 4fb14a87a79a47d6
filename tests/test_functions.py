import pytest
from pyspark.sql import functions as F

from tapewright.functions import fixedpoint as fp
from tapewright.functions import identity, orders
from tapewright.functions import requests as rq
from tapewright.operators import ops
from tapewright.operators.quantiles import quantiles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


PRICES = [("0.0800", 800), ("0.960", 9600), ("1", 10000), ("1.0000", 10000), ("1.0001", None), ("1.00001", None), ("0.96001", None), ("-0.1", None), ("+0.1", None), ("", None), (".", None), (".5", 5000), ("1.", 10000), ("0x", None), ("0" * 25, None), ("00000000000000000000.5", 5000), (None, None)]


def test_prices(spark):
    rows = spark.createDataFrame(PRICES, "s string, want int").select("*", fp.parse_price_e4(F.col("s")).alias("got")).collect()
    assert [r.got for r in rows] == [w for _, w in PRICES]


@pytest.mark.parametrize("f,s,want", [(fp.parse_count_fp, "300.00", 30000), (fp.parse_count_fp, "5", 500), (fp.parse_count_fp, "-5", None), (fp.parse_count_fp, "1.234", None), (fp.parse_count_fp, "9999999999999", None), (fp.parse_delta_fp, "-54.00", -5400), (fp.parse_delta_fp, "12.5", 1250), (fp.parse_delta_fp, "--1", None), (fp.parse_delta_fp, "-", None)])
def test_counts(spark, f, s, want):
    assert one(spark, f(F.lit(s))) == want


def test_formats(spark):
    assert one(spark, fp.format_price_e4(F.lit(800))) == "0.0800" and one(spark, fp.format_price_e4(F.lit(10000))) == "1.0000"
    assert one(spark, fp.format_count_fp(F.lit(-5400))) == "-54.00" and one(spark, fp.format_count_fp(F.lit(-7))) == "-0.07"
    assert one(spark, fp.e4_to_cents(F.lit(4250))) == 43 and one(spark, fp.cents_to_e4(F.lit(43))) == 4300


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_ids(spark):
    for t in ("KXABC-24", "", "é🙂", "A" * 70):
        assert one(spark, identity.entity_id(F.lit(3), F.lit(t))) == fnv(bytes([3]) + t.encode())
    want = "00000001-0002-0003-0700-000000000005"
    assert one(spark, identity.client_order_id(F.lit((1 << 32) + (2 << 16) + 3), F.lit(7), F.lit(5))) == want


def test_order_rules(spark):
    assert one(spark, orders.fee_cents(F.lit(175), F.lit(10), F.lit(40))) == 5
    assert one(spark, orders.risk_cents(F.lit(10), F.lit(40), F.lit(True))) == 400 and one(spark, orders.risk_cents(F.lit(10), F.lit(40), F.lit(False))) == 600
    assert one(spark, orders.crossed(F.lit(4600), orders.implied_yes_ask(F.lit(5500)))) is True
    assert one(spark, orders.crossed(F.lit(None).cast("int"), F.lit(1))) is False
    assert one(spark, orders.yes_cents(F.lit("limit"), F.lit(True), F.lit(False), F.lit(30))) == 70


CASES = [
    ("POST", "/portfolio/events/orders", "write", "create_order"), ("GET", "/portfolio/orders?x=1", "read", "none"), ("DELETE", "/portfolio/orders/abc", "write", "cancel_order"), ("POST", "/portfolio/orders/abc/amend", "write", "amend_order"),
    ("POST", "/portfolio/orders/batched", "write", "order_group"), ("GET", "/portfolio/order_groups", "write", "order_group"), ("GET", "/communications/rfqs", "write", "quote"), ("POST", "/block_trades/1", "write", "none"), ("GET", "markets", "read", "none"),
]


def test_classify(spark):
    d = spark.createDataFrame(CASES, "m string, p string, b string, k string").withColumn("w", rq.endpoint_path(F.col("p")))
    for r in d.select("*", rq.bucket(F.col("m"), F.col("w")).alias("gb"), rq.mutation(F.col("m"), F.col("w")).alias("gk")).collect():
        assert (r.gb, r.gk) == (r.b, r.k) and r.w.startswith("/trade-api/v2/") and "?" not in r.w


def test_retry_and_backoff(spark):
    def go(kind, status, broken, attempt):
        r = spark.range(1).select(*(c.alias(k) for k, c in rq.retry(F.lit(kind), F.lit(status), F.lit(broken), F.lit(attempt), 3).items())).first()
        return r.retry, r.needs_reconcile, r.accounting_drift

    assert go("create_order", 429, False, 0) == (True, False, True)
    assert go("create_order", 503, False, 0) == (False, True, False)
    assert go("cancel_order", 0, True, 0) == (True, False, False) and go("none", 502, False, 2) == (False, False, False)
    assert go("none", 400, False, 0) == (False, False, False)
    low, high = rq.backoff_bounds(F.lit(3), 100, 500)
    assert (one(spark, low), one(spark, high)) == (250, 500)


def test_costs(spark):
    table = [("GET", "/a/:id", 3), ("GET", "/a/b", 7), ("GET", "/c/*rest", 4), ("GET", "/{x}/z", 5)]
    want = {"/a/b": 7, "/a/q": 3, "/a/q/r": 10, "/c": 10, "/c/1": 4, "/c/1/2": 4, "/y/z": 5, "//a//q/": 3}
    d = spark.createDataFrame([("GET", p) for p in want], "method string, wire_path string")
    assert {r.wire_path: r.cost for r in ops.costs(d, table).collect()} == want


def test_latency(spark):
    assert one(spark, rq.us_between(F.lit(0), F.lit(5))) == -1 and one(spark, rq.us_between(F.lit(9), F.lit(5))) == -1 and one(spark, rq.us_between(F.lit(1000), F.lit(3500))) == 2.5
    d = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double")
    assert quantiles(d, ("k",), "v", {"p": 0.99}, True).first().p == 10 and quantiles(d, ("k",), "v", {"p": 0.5}, True).first().p == 6


def test_limits(spark):
    assert one(spark, rq.limits_error("read", F.lit(0), F.lit(5))) == "read refill_rate <= 0 (0)"
    assert one(spark, rq.limits_error("read", F.lit(100), F.lit(49))) == "read bucket_capacity 49 < refill_rate/2 (50)"
    assert one(spark, rq.limits_error("read", F.lit(100), F.lit(50))) is None


def test_token_bucket_needs_a_rate(spark):
    d = spark.createDataFrame([(1, "b", 1, 0, 1)], "account long, bucket string, req_id long, now_ns long, cost long")
    for rate, capacity in ((0, 5), (5, 0)):
        with pytest.raises(ValueError):
            ops.token_bucket(d, rate, capacity, 1)


def test_token_bucket(spark):
    rows = [(1, 0, 100), (2, 0, 50), (3, 10**9, 10)]  # rate 100 a second, 100 at most, half a second of debt
    d = spark.createDataFrame([(1, "write", i, t, c) for i, t, c in rows], "account long, bucket string, req_id long, now_ns long, cost long")
    got = {r.req_id: r for r in ops.token_bucket(d, 100, 100, 5 * 10**8).collect()}
    assert (got[1].granted, got[1].wait_ns, got[1].after) == (True, 0, 0)
    assert (got[2].granted, got[2].wait_ns, got[2].after) == (True, 5 * 10**8, -50000)
    assert (got[3].granted, got[3].before, got[3].after) == (True, 50000, 40000)
    none = {r.req_id: r for r in ops.token_bucket(d, 100, 100, 5 * 10**8 - 1).collect()}
    assert (none[2].granted, none[2].before, none[2].after) == (False, 0, 0)


def test_token_bucket_does_not_drift(spark):
    d = spark.createDataFrame([(1, "r", i, i * 333_333_333, 1) for i in range(3000)], "account long, bucket string, req_id long, now_ns long, cost long")
    last = ops.token_bucket(d, 3, 10, 10**12).orderBy("req_id").collect()[-1]
    spent, earned = 3000 * 1000, 2999 * 333_333_333 * 3 // 10**6
    assert abs(last.after - (10_000 + earned - spent)) <= 1000
