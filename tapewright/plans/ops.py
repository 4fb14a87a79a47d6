"""Queries over request logs, latency stamps and console events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import requests as rq
from tapewright.operators import ops
from tapewright.operators.quantiles import quantiles
from tapewright.plans.portable import oracle, over
from tapewright.plans.views import load, view, with_views

COSTS = [("POST", "/trade-api/v2/portfolio/events/orders", 10), ("DELETE", "/trade-api/v2/portfolio/events/orders/:order_id", 2), ("POST", "/trade-api/v2/portfolio/*rest", 20), ("GET", "/trade-api/v2/{page}", 5)]
RATE, CAPACITY, MAX_WAIT_NS = 1, 30, 5 * 10**9


def _classified(spark, sf_dir):
    path = rq.endpoint_path(F.col("path"))
    r = view(spark, sf_dir, "requests").withColumn("wire_path", path)
    return r.withColumn("bucket", rq.bucket(F.col("method"), F.col("wire_path"))).withColumn("mutation", rq.mutation(F.col("method"), F.col("wire_path")))


def request_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("req_id", "method", "wire_path", "bucket", "mutation")


def endpoint_cost(spark, sf_dir):
    return ops.costs(_classified(spark, sf_dir), COSTS).groupBy("method", "cost").agg(F.count(F.lit(1)).alias("n"))


def retry_decision(spark, sf_dir):
    attempt = (F.col("req_id") % 4).cast("int")
    d = rq.retry(F.col("mutation"), F.col("http_status"), F.col("transport_error"), attempt, 3)
    low, high = rq.backoff_bounds(attempt, 250, 1500)
    return _classified(spark, sf_dir).select("req_id", *(c.alias(k) for k, c in d.items()), low.alias("wait_low_ms"), high.alias("wait_high_ms"))


def request_rollup(spark, sf_dir):
    r = _classified(spark, sf_dir).withColumn("outcome", F.when(F.col("transport_error"), "transport").when(F.col("http_status") >= 400, "error").otherwise("ok"))
    return r.cube("bucket", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("http_status") == 429).alias("drift")).select(F.coalesce("bucket", F.lit("all")).alias("bucket"), F.coalesce("outcome", F.lit("all")).alias("outcome"), "n", "drift")


def request_telemetry(spark, sf_dir):
    return ops.telemetry(ops.costs(_classified(spark, sf_dir), COSTS))


def book_state(spark, sf_dir):
    """The last known bid and ask of each market, each from the newest row that has it."""
    return ops.merged_state(view(spark, sf_dir, "l1"), "ticker", "event_id", "yes_bid", "yes_ask")


def token_bucket_replay(spark, sf_dir):
    r = ops.costs(_classified(spark, sf_dir), COSTS).select("req_id", "account", "bucket", F.col("cost").cast("bigint").alias("cost"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 1000).alias("now_ns"))
    return ops.token_bucket(r, RATE, CAPACITY, MAX_WAIT_NS)


def _spans(spark, sf_dir):
    s = view(spark, sf_dir, "spans").select("trace_id", rq.us_between(F.col("data_received"), F.col("data_parsed")).alias("parse_us"), rq.us_between(F.col("data_parsed"), F.col("sign_start")).alias("wait_us"), rq.us_between(F.col("sign_start"), F.col("sign_done")).alias("sign_us"))
    return s.unpivot("trace_id", ["parse_us", "wait_us", "sign_us"], "span", "us").where("us >= 0")


def latency_report(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    q = quantiles(rows, ("span",), "us", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("n")
    sums = rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("max_us"), F.min("us").alias("min_us"), F.round(F.avg("us"), 3).alias("mean_us"))
    return sums.join(q, "span").select("span", "n", *(F.round(p, 3).alias(p) for p in ("p50", "p90", "p99")), "max_us", "min_us", "mean_us")


def latency_floor_percentile(spark, sf_dir):
    return quantiles(_spans(spark, sf_dir), ("span",), "us", {"p99_us": 0.99}, whole=True).drop("n")


def rtt_budget(spark, sf_dir):
    """The worst span's 99th percentile with a quarter on top."""
    return latency_report(spark, sf_dir).agg(F.round(F.max("p99") * 1.25, 3).alias("budget_us"))


def regression_gate(spark, sf_dir):
    """Three runs before and after; the median of each percentile may not be over a tenth worse."""
    s = _spans(spark, sf_dir).withColumn("run", (F.col("trace_id") % 6).cast("int"))
    by_run = quantiles(s, ("span", "run"), "us", {"p50": 0.5, "p99": 0.99}).unpivot(["span", "run"], ["p50", "p99"], "which", "us")
    sides = quantiles(by_run.withColumn("side", F.when(F.col("run") < 3, "before").otherwise("after")), ("span", "which", "side"), "us", {"mid": 0.5})
    side = sides.groupBy("span").agg(*(F.max(F.when((F.col("which") == c) & (F.col("side") == w), F.col("mid"))).alias(f"{c}_{w}") for c in ("p50", "p99") for w in ("before", "after")))
    return side.select("span", *(F.round(c, 3).alias(c) for c in ("p50_before", "p50_after", "p99_before", "p99_after")), ((F.col("p50_after") > 1.1 * F.col("p50_before")) | (F.col("p99_after") > 1.1 * F.col("p99_before"))).alias("fails"))


def batch_costs(spark, sf_dir):
    """What the orders of each account and hour would cost in batches, at ten tokens an order; rows without orders cost nothing."""
    r = view(spark, sf_dir, "requests").groupBy("account", F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(F.col("method") == "POST").alias("items"))
    cost = rq.batch_cost(F.col("items"), F.lit(10))
    return r.groupBy("account").agg(F.count(F.lit(1)).alias("hours"), F.sum(cost).alias("tokens"), F.max(cost).alias("most"))


def ops_latest_state(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return ops.latest(e, "event_type", "event_id", "event_id", "user_id", "value")


def risk_summary(spark, sf_dir):
    why = F.element_at(F.array(*map(F.lit, ("stale_book", "dup_order", "risk_cap", "halted"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy(rq.folded_reason(why).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "event_id").alias("last_value"))


def order_telemetry(spark, sf_dir):
    kinds = ("submitted", "expired", "rate_limited", "transport_error", "sign_error", "dropped_full", "rejected_invalid", "shadow")
    r = view(spark, sf_dir, "requests").withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), (F.col("req_id") % 8 + 1).cast("int")))
    status, reason = rq.order_status(F.col("kind"), F.col("http_status"))
    return r.groupBy("kind", status.alias("status"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def feed_health(spark, sf_dir):
    """Health of each feed as of a fixed time, from when it was last seen."""
    last = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", "event_id").alias("kind"))
    age = F.expr("timestampdiff(HOUR, ts, timestamp_ntz'2024-01-31 00:00:00')")
    return last.select("user_id", rq.feed_health(F.col("kind") != "error", F.col("kind") != "signup", age).alias("health"), rq.heartbeat(age).alias("heartbeat"))


def event_rate(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("r", ops.order_rate("ts", "user_id", 86400))
    return e.groupBy("user_id").agg(F.max("r").alias("peak_day"), F.count(F.lit(1)).alias("n"))


def limits_check(spark, sf_dir):
    """Invariants and tier warnings of a limits table derived from customers."""
    tier = F.element_at(F.array(*map(F.lit, ("basic", "advanced", "premier", "paragon", "prime", "expert"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    refill, cap = (F.col("c_custkey") % 5 * 100).cast("bigint"), (F.col("c_custkey") % 7 * 400).cast("bigint")
    tiers = spark.createDataFrame([("basic", 200, 100), ("advanced", 300, 300), ("premier", 1000, 1000), ("paragon", 2000, 2000), ("prime", 4000, 4000)], "tier string, read_refill bigint, write_refill bigint")
    x = load(spark, sf_dir, "customer").select("c_custkey", tier.alias("tier"), refill.alias("refill"), cap.alias("capacity")).join(F.broadcast(tiers), "tier", "left")  # five rows
    return x.select("c_custkey", "tier", F.coalesce(rq.limits_error("read", F.col("refill"), F.col("capacity")), F.lit("ok")).alias("verdict"), F.coalesce(F.col("read_refill") != F.col("refill"), F.lit(False)).alias("differs_from_tier"))


def reserve_before_send(spark, sf_dir):
    """Requests of the log that reached the server against the grants of the replay: those sent without one, and grants not used."""
    sent = view(spark, sf_dir, "requests").select("req_id", (~F.col("transport_error")).alias("sent"))
    g = token_bucket_replay(spark, sf_dir).join(sent, "req_id")
    return g.groupBy("bucket").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("granted")).alias("refused"), F.count_if(~F.col("granted") & F.col("sent")).alias("sent_without_grant"), F.count_if(F.col("granted") & ~F.col("sent")).alias("granted_not_sent"))


def class_rollup(spark, sf_dir):
    """Accounts by class."""
    r = view(spark, sf_dir, "requests").withColumn("cls", F.when(F.col("method") == "GET", "READY").otherwise("SHADOW"))
    status = F.col("http_status")
    return ops.class_rollup(r, ("account",), "cls", {"rate_limited": status == 429, "unavailable": status == 503, "transport": F.col("transport_error")})


_SQL = {
    "order_rate_seconds": oracle("select cast(date_trunc('hour', ts) as varchar(30)) as slot, count(*) as n from {requests} where method <> 'GET' group by 1"),
    "status_tally": oracle("select http_status, count(*) as n, sum(case when method = 'GET' then 1 else 0 end) as reads from {requests} group by http_status"),
    "call_cost": oracle("select method, count(*) as calls, round(200.0e0 * count(distinct date_trunc('hour', ts)) / sum(case when http_status = 200 then 1 else 0 end), 6) as inferred_cost from {requests} group by method"),
    "blocker_top10": oracle("select concat(method, ' ', cast(http_status as varchar(5))) as blocker, count(*) as n from {requests} where http_status <> 200 or transport_error group by 1 order by n desc, blocker limit 10"),
    "stale_orders": oracle("""with a as (select *, date_diff('microsecond', lag(ts) over (partition by account order by ts, req_id), ts) as age, case method when 'POST' then 7200000000 when 'DELETE' then 3600000000 else 0 end as ttl from {requests})
select case when ttl <> 0 and age > ttl then 'expired_ttl' when age > 18000000000 then 'expired_queue' else 'sent' end as gate, case account % 3 when 0 then 'data_collect' when 1 then 'shadow' else 'live' end as mode, count(*) as n from a group by 1, 2"""),
    "recent_requests": oracle("select req_id, method, http_status from {requests} where lower(concat(method, path)) like '%orders%' order by req_id desc limit 200"),
    "retained_per_account": oracle("select account, req_id from (select account, req_id, row_number() over (partition by account order by req_id desc) as k from {requests}) x where k <= 100"),
    "win_loss_bands": oracle("select t.ticker, cast(floor(price_cents / 10.0e0) as int) as band, sum(case when yes_wins then 1 else 0 end) as wins, count(*) as n, cast(sum(size * (case when yes_wins then 100 else 0 end - price_cents)) as bigint) as pnl_cents from {tape} t join {settles} s on t.ticker = s.ticker group by 1, 2"),
    "win_loss_by_close": oracle("""with s as (select t.*, s.yes_wins, max(t.ts) over (partition by t.ticker) as close_ts from {tape} t join {settles} s on t.ticker = s.ticker)
select cast(floor(date_diff('day', ts, close_ts) / 180.0e0) as int) as band, count(*) filter (yes_wins) as wins, count(*) as n, round(count(*) filter (yes_wins) / count(*), 6) as rate, cast(sum(size * (case when yes_wins then 100 else 0 end - price_cents)) as bigint) as pnl_cents from s group by 1"""),
    "strategy_positions": oracle("""with o as (select family, ticker, sum(size) as n, sum(size * price_cents) as cost, arg_max(price_cents, tape_id) as mark from {tape} where ticker not in (select ticker from {settles} where cast(substr(ticker, 3) as int) % 3 <> 0) group by 1, 2)
select family as book, count(*) as open_markets, cast(sum(n) as bigint) as contracts, cast(sum(cost) as bigint) as collateral_cents, cast(sum(n * mark - cost) as bigint) as floating_cents from o group by 1"""),
    "strategy_books": oracle("select family as book, count(distinct t.ticker) as markets, cast(sum(case when yes_wins then size * (100 - price_cents) else -size * price_cents end) as bigint) as realized_cents, sum(case when yes_wins then 1 else 0 end) as wins, sum(case when yes_wins then 0 else 1 end) as losses from {tape} t join {settles} s on t.ticker = s.ticker group by family"),
    "daily_edge": oracle("with p as (select cast(cast(ts as date) as varchar(10)) as day, size * (case when yes_wins then 100 else 0 end - price_cents) as pnl from {tape} t join {settles} s on t.ticker = s.ticker) select day, cast(sum(case when pnl between 0 and 500 then pnl else 0 end) as bigint) as freq_edge, cast(sum(case when pnl < -500 then pnl else 0 end) as bigint) as mag_edge, cast(sum(pnl) as bigint) as net from p group by day"),
    "set_differences": oracle("with a as (select distinct ticker from {tape}), b as (select ticker from {dim_market}) select 'missing' as side, count(*) as n from (select ticker from a except select ticker from b) x union all select 'extra', count(*) from (select ticker from b except select ticker from a) y"),
    "kind_counts": oracle("select kind, count(*) as n, sum(case when side = 'yes' then 1 else 0 end) as yes_side from {frames} group by kind"),
    "class_rollup": oracle("""with b as (select account, case when method = 'GET' then 'READY' else 'SHADOW' end as cls, unnest([case when http_status = 429 then 'rate_limited' end, case when http_status = 503 then 'unavailable' end, case when transport_error then 'transport' end]) as blocker from {requests}),
a as (select account, cls, coalesce(list_sort(list_distinct(list(blocker) filter (blocker is not null))), []) as blockers from b group by account, cls)
select case when len(blockers) > 0 then 'BLOCKED' else cls end as class, case when len(blockers) > 0 then cls else '' end as blocked_from, blockers, count(*) as n from a group by all"""),
}

def _settled(spark, sf_dir):
    return view(spark, sf_dir, "prints").join(view(spark, sf_dir, "settles"), "ticker")


def reconcile_queue(spark, sf_dir):
    """Writes whose outcome is unknown and that may not be sent twice, by account."""
    d = rq.retry(F.col("mutation"), F.col("http_status"), F.col("transport_error"), F.lit(0), 3)
    return ops.tallied(_classified(spark, sf_dir).where(d["needs_reconcile"]), "account")


_Q = {
    "order_rate_seconds": over(ops.orders_by_hour, "requests"),
    "reconcile_queue": reconcile_queue,
    "status_tally": over(ops.status_tally, "requests"),
    "call_cost": over(ops.call_cost, "requests", tokens=200),
    "blocker_top10": over(ops.top_blockers, "requests", most=10),
    "stale_orders": over(ops.gates_and_modes, "requests", ttl={"POST": 7200, "DELETE": 3600}, most_s=18000, modes=("data_collect", "shadow", "live")),
    "recent_requests": over(ops.recent, "requests", word="orders", most=200),
    "retained_per_account": over(ops.retained, "requests", most=100),
    "win_loss_by_close": lambda spark, sf_dir: ops.win_loss_by_close(_settled(spark, sf_dir), 180),
    "strategy_positions": lambda spark, sf_dir: ops.positions(view(spark, sf_dir, "tape"), view(spark, sf_dir, "settles").where("cast(substr(ticker, 3) as int) % 3 <> 0")),  # every third is still open
    "win_loss_bands": lambda spark, sf_dir: ops.win_loss(_settled(spark, sf_dir), 10),
    "strategy_books": lambda spark, sf_dir: ops.books(_settled(spark, sf_dir)),
    "daily_edge": lambda spark, sf_dir: ops.daily_edge(_settled(spark, sf_dir), 500),
    "set_differences": lambda spark, sf_dir: ops.set_differences(view(spark, sf_dir, "prints").select("ticker"), view(spark, sf_dir, "dim_market").select("ticker")),
    "kind_counts": over(ops.kind_counts, "messages"),
}

QUERIES = {f.__name__: f for f in (request_telemetry, book_state, request_classify, endpoint_cost, retry_decision, request_rollup, token_bucket_replay, latency_report, latency_floor_percentile, rtt_budget, regression_gate, batch_costs, ops_latest_state, risk_summary, order_telemetry, feed_health, event_rate, limits_check, reserve_before_send)} | _Q | {"class_rollup": class_rollup}

def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


_CL = """, w as (select *, '/trade-api/v2' || split_part(path, '?', 1) as wire_path from requests), sg as (select *, string_split(wire_path, '/') as s from w),
cl as (select *, case when list_has_any(s, ['order_groups', 'rfqs', 'quotes']) then 'write' when list_contains(s, 'orders') then case when list_contains(s, 'batched') or method <> 'GET' then 'write' else 'read' end else 'read' end as bucket,
  case when list_contains(s, 'order_groups') then 'order_group' when list_contains(s, 'orders') then case when list_contains(s, 'batched') then 'order_group' when method = 'DELETE' then 'cancel_order' when method = 'POST' then 'create_order' else 'none' end else 'none' end as mutation from sg)
"""
_SP = """, u as (select trace_id, unnest(['parse_us', 'wait_us', 'sign_us']) as span, unnest([case when data_received = 0 or data_parsed = 0 or data_parsed < data_received then -1 else (data_parsed - data_received) / 1000 end,
  case when data_parsed = 0 or sign_start = 0 or sign_start < data_parsed then -1 else (sign_start - data_parsed) / 1000 end, case when sign_start = 0 or sign_done = 0 or sign_done < sign_start then -1 else (sign_done - sign_start) / 1000 end]) as us from spans), x as (select * from u where us >= 0)
"""
_REPLAY = _CL + f""", rq as (select account, bucket, req_id, transport_error, epoch_us(ts) * 1000 as now, cast(case when method = 'POST' and wire_path = '/trade-api/v2/portfolio/events/orders' then 10 when method = 'DELETE' and regexp_full_match(wire_path, '/trade-api/v2/portfolio/events/orders/[^/]+') then 2 when method = 'POST' and wire_path like '/trade-api/v2/portfolio/_%' then 20 when method = 'GET' and regexp_full_match(wire_path, '/trade-api/v2/[^/]+') then 5 else 10 end as bigint) as cost, row_number() over (partition by account, bucket order by ts, req_id) as k from cl),
bk as (select account, bucket, req_id, k, now, {CAPACITY * 1000}::bigint as before, 0::hugeint as carry, cost * 1000 as need, 0::hugeint as wait, case when cost <= {CAPACITY} then {CAPACITY * 1000} - cost * 1000 else {CAPACITY * 1000} end::bigint as after, cost <= {CAPACITY} as granted from rq where k = 1
union all select account, bucket, req_id, k, now, tokens, c, need, wt, case when wt <= {MAX_WAIT_NS} then tokens - need else tokens end, wt <= {MAX_WAIT_NS} from (
  select *, case when need <= tokens then 0 else ((need - tokens)::hugeint * 1000000000 - c + {RATE * 1000} - 1) // {RATE * 1000} end as wt from (
    select account, bucket, req_id, k, now, need, least({CAPACITY * 1000}, t)::bigint as tokens, case when t >= {CAPACITY * 1000} and was < {CAPACITY * 1000} then 0 else c0 end as c from (
      select r.account, r.bucket, r.req_id, r.k, r.now, r.cost * 1000 as need, bk.after as was, case when bk.after < {CAPACITY * 1000} then bk.after + e // 1000000000 else bk.after end as t, case when bk.after < {CAPACITY * 1000} then e % 1000000000 else bk.carry end as c0
      from bk join rq r on r.account = bk.account and r.bucket = bk.bucket and r.k = bk.k + 1, lateral (select (r.now - bk.now)::hugeint * {RATE * 1000} + bk.carry as e)))))
"""
ORACLE_SQL = {
    "token_bucket_replay": _recursive(with_views("requests", _REPLAY + "select account, bucket, req_id, granted, cast(case when granted then wait else 0 end as bigint) as wait_ns, before, after from bk")),
    "reserve_before_send": _recursive(with_views("requests", _REPLAY + "select bk.bucket, count(*) as requests, count(*) filter (not granted) as refused, count(*) filter (not granted and not transport_error) as sent_without_grant, count(*) filter (granted and transport_error) as granted_not_sent from bk join rq using (req_id) group by 1")),
    "book_state": with_views("l1", "select ticker, arg_max(yes_bid, event_id) filter (yes_bid is not null) as yes_bid, arg_max(yes_ask, event_id) filter (yes_ask is not null) as yes_ask from l1 group by ticker"),
    "request_telemetry": with_views("requests", _CL + "select case when transport_error then 'transport' when http_status >= 400 then 'error' else 'ok' end as outcome, bucket, regexp_replace(wire_path, '[0-9]+', ':id', 'g') as path, count(*) as n, cast(sum(case when method = 'POST' and wire_path = '/trade-api/v2/portfolio/events/orders' then 10 when method = 'DELETE' and regexp_full_match(wire_path, '/trade-api/v2/portfolio/events/orders/[^/]+') then 2 when method = 'POST' and wire_path like '/trade-api/v2/portfolio/_%' then 20 when method = 'GET' and regexp_full_match(wire_path, '/trade-api/v2/[^/]+') then 5 else 10 end) as bigint) as tokens, count(*) filter (http_status = 429) as drift from cl group by 1, 2, 3"),
    "reconcile_queue": with_views("requests", _CL + "select account, count(*) as n from cl where http_status <> 429 and (transport_error or http_status in (502, 503, 504)) and mutation in ('create_order', 'amend_order', 'order_group', 'quote') group by account"),
    "request_classify": with_views("requests", _CL + "select req_id, method, wire_path, bucket, mutation from cl"),
    "endpoint_cost": with_views("requests", _CL + "select method, cast(case when method = 'POST' and wire_path = '/trade-api/v2/portfolio/events/orders' then 10 when method = 'DELETE' and regexp_full_match(wire_path, '/trade-api/v2/portfolio/events/orders/[^/]+') then 2 when method = 'POST' and wire_path like '/trade-api/v2/portfolio/_%' then 20 when method = 'GET' and regexp_full_match(wire_path, '/trade-api/v2/[^/]+') then 5 else 10 end as int) as cost, count(*) as n from cl group by 1, 2"),
    "retry_decision": with_views("requests", _CL + """, d as (select *, req_id % 4 as a, transport_error or http_status in (502, 503, 504) as amb, mutation in ('create_order', 'amend_order', 'order_group', 'quote') as once from cl)
select req_id, case when http_status = 429 then a + 1 < 3 when amb then not once and a + 1 < 3 else false end as retry, http_status <> 429 and amb and once as needs_reconcile, http_status = 429 as accounting_drift, least(1500, 250 * (1 << a)) // 2 as wait_low_ms, least(1500, 250 * (1 << a)) as wait_high_ms from d"""),
    "request_rollup": with_views("requests", _CL + "select coalesce(bucket, 'all') as bucket, coalesce(outcome, 'all') as outcome, count(*) as n, count(*) filter (http_status = 429) as drift from (select *, case when transport_error then 'transport' when http_status >= 400 then 'error' else 'ok' end as outcome from cl) group by cube (bucket, outcome)"),
    "latency_report": with_views("spans", _SP + "select span, count(*) as n, round(quantile_cont(us, 0.5), 3) as p50, round(quantile_cont(us, 0.9), 3) as p90, round(quantile_cont(us, 0.99), 3) as p99, max(us) as max_us, min(us) as min_us, round(avg(us), 3) as mean_us from x group by span"),
    "batch_costs": with_views("requests", """, h as (select account, date_trunc('hour', ts) as hour, count(*) filter (method = 'POST') as items from requests group by 1, 2)
select account, count(*) as hours, cast(sum(items * 10) as bigint) as tokens, max(items * 10) as most from h group by 1"""),
    "latency_floor_percentile": with_views("spans", _SP + "select span, us as p99_us from (select *, row_number() over (partition by span order by us) as k, count(*) over (partition by span) as n from x) where k = least(n, floor(n * 0.99::double) + 1)"),
    "rtt_budget": with_views("spans", _SP + "select round(max(p) * 1.25, 3) as budget_us from (select round(quantile_cont(us, 0.99), 3) as p from x group by span)"),
    "regression_gate": with_views("spans", _SP + """, r as (select span, trace_id % 6 as run, quantile_cont(us, 0.5) as p50, quantile_cont(us, 0.99) as p99 from x group by 1, 2),
s as (select span, quantile_cont(p50, 0.5) filter (run < 3) as a, quantile_cont(p50, 0.5) filter (run >= 3) as b, quantile_cont(p99, 0.5) filter (run < 3) as c, quantile_cont(p99, 0.5) filter (run >= 3) as d from r group by span)
select span, round(a, 3) as p50_before, round(b, 3) as p50_after, round(c, 3) as p99_before, round(d, 3) as p99_after, b > 1.1 * a or d > 1.1 * c as fails from s"""),
    "ops_latest_state": "select event_type, max(event_id) as event_id, arg_max(user_id, event_id) as user_id, arg_max(value, event_id) as value from events group by event_type",
    "risk_summary": "select case event_id % 4 when 0 then 'stale_signal' when 1 then 'duplicate' when 2 then 'risk_check' else 'other' end as reason, count(*) as n, arg_max(value, event_id) as last_value from events where event_type = 'error' group by 1",
    "order_telemetry": with_views("requests", """, k as (select *, (['submitted', 'expired', 'rate_limited', 'transport_error', 'sign_error', 'dropped_full', 'rejected_invalid', 'shadow'])[req_id % 8 + 1] as kind from requests)
select kind, case when kind = 'submitted' and http_status >= 400 then 'rejected' when kind = 'submitted' then 'sent' when kind in ('expired', 'rate_limited', 'dropped_full') then 'dropped' when kind like '%error' then 'error' when kind = 'rejected_invalid' then 'rejected' else 'shadow' end as status,
  case kind when 'submitted' then '' when 'dropped_full' then 'queue_full' when 'rejected_invalid' then 'invalid' else kind end as reason, count(*) as n from k group by 1, 2, 3"""),
    "feed_health": """with l as (select user_id, date_diff('microsecond', max(ts), timestamp '2024-01-31 00:00:00') // 3600000000 as age, arg_max(event_type, event_id) as kind from events group by user_id)
select user_id, case when kind = 'error' then 'down' when kind = 'signup' or age > 3 then 'degraded' else 'up' end as health, case when age > 5 then 'stale' when age > 2 then 'lagging' else 'ok' end as heartbeat from l""",
    "event_rate": "select user_id, max(r) as peak_day, count(*) as n from (select user_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 86400 preceding and current row) as r from events) group by user_id",
    "limits_check": """with c as (select c_custkey, (['basic', 'advanced', 'premier', 'paragon', 'prime', 'expert'])[c_custkey % 6 + 1] as tier, c_custkey % 5 * 100 as refill, c_custkey % 7 * 400 as capacity from customer)
select c_custkey, tier, case when refill <= 0 then 'read refill_rate <= 0 (' || refill || ')' when capacity < refill // 2 then 'read bucket_capacity ' || capacity || ' < refill_rate/2 (' || refill // 2 || ')' when capacity > refill * 10 then 'read bucket_capacity ' || capacity || ' > refill_rate*10 (' || refill * 10 || ')' else 'ok' end as verdict,
  coalesce((case tier when 'basic' then 200 when 'advanced' then 300 when 'premier' then 1000 when 'paragon' then 2000 when 'prime' then 4000 end) <> refill, false) as differs_from_tier from c""",
} | _SQL
