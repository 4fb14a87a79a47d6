"""Queries over the trade tape: functions of prices and orders, quotes, fills, ledger and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions import fixedpoint, identity, orders
from tapewright.operators import exposure, extension, fills, quotes
from tapewright.plans.views import fnv_sql, view, with_views
from tapewright.sources.scratch import written

SPEEDS = (0, 1, 5)  # days: the reference's latency settings, scaled to a tape of whole days
HORIZON = 3


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tape").select("ticker").distinct().select("ticker", identity.entity_id(F.lit(1), F.col("ticker")).alias("entity_id"))


def entity_collisions(spark, sf_dir):
    """Ids that two (source, ticker) keys share: none may exist."""
    keys = view(spark, sf_dir, "tape").select("ticker").distinct().crossJoin(spark.range(1, 9).withColumnRenamed("id", "source"))  # eight sources
    return keys.select(identity.entity_id(F.col("source"), F.col("ticker")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("keys")).select(F.count_if(F.col("keys") > 1).alias("collisions"), F.sum("keys").alias("keys"))


def _texts(spark, sf_dir):
    """Decimal texts of many shapes from the tape's prices and sizes."""
    p, n = F.col("price_cents"), F.col("tape_id")
    text = (
        F.when(n % 7 == 0, F.format_string("0.%02d00", p)).when(n % 7 == 1, F.format_string(".%02d", p)).when(n % 7 == 2, F.format_string("%d.", p))
        .when(n % 7 == 3, F.format_string("-%d.%d", F.col("size"), p % 10)).when(n % 7 == 4, F.format_string("0.%02d001", p)).when(n % 7 == 5, F.concat(p.cast("string"), F.lit("x"))).otherwise(F.format_string("1.%04d", p % 2))
    )
    return view(spark, sf_dir, "tape").select("tape_id", "price_cents", text.alias("s"))


_TEXTS = """, texts as (select tape_id, price_cents, case cast(tape_id % 7 as int) when 0 then printf('0.%02d00', price_cents) when 1 then printf('.%02d', price_cents) when 2 then printf('%d.', price_cents)
  when 3 then printf('-%d.%d', size, price_cents % 10) when 4 then printf('0.%02d001', price_cents) when 5 then price_cents || 'x' else printf('1.%04d', price_cents % 2) end as s from tape)
"""


def fixed_point_parse(spark, sf_dir):
    s = F.col("s")
    return _texts(spark, sf_dir).select("tape_id", "s", fixedpoint.parse_price_e4(s).alias("price_e4"), fixedpoint.parse_count_fp(s).alias("count_fp"), fixedpoint.parse_delta_fp(s).alias("delta_fp"))


def fixed_point_format(spark, sf_dir):
    e4 = F.col("price_cents") * 100 + (F.col("tape_id") % 100).cast("int")
    fp = F.col("size") * F.when(F.col("taker_yes"), 1).otherwise(-1) * 7
    return view(spark, sf_dir, "tape").select("tape_id", fixedpoint.format_price_e4(e4).alias("price"), fixedpoint.format_count_fp(fp).alias("count"), fixedpoint.cents_to_e4(F.col("price_cents")).alias("e4"), fixedpoint.e4_to_cents(e4).alias("cents"))


def _intents(spark, sf_dir):
    q, c = view(spark, sf_dir, "quotes"), F.col("cid")
    return q.select(
        "cid", (c % 32).cast("int").alias("strategy"), F.when(c % 19 == 0, "hold").when(F.col("buy_yes"), "buy").otherwise("sell").alias("action"), F.when(c % 23 == 0, "both").when(c % 3 == 0, "no").otherwise("yes").alias("side"),
        F.when(c % 29 == 0, "stop").when(c % 5 == 0, "market").otherwise("limit").alias("kind"), F.when(c % 31 == 0, 0).otherwise(F.col("count")).alias("count"), F.when(c % 37 == 0, 100).otherwise(F.col("price_cents")).alias("price_cents"),
        F.when(c % 41 == 0, "").when(c % 43 == 0, F.concat("ticker", F.lit(" "))).otherwise(F.col("ticker")).alias("ticker"),
    )


_INTENTS = """, intents as (select cid, cast(cid % 32 as int) as strategy, case when cid % 19 = 0 then 'hold' when buy_yes then 'buy' else 'sell' end as action, case when cid % 23 = 0 then 'both' when cid % 3 = 0 then 'no' else 'yes' end as side,
  case when cid % 29 = 0 then 'stop' when cid % 5 = 0 then 'market' else 'limit' end as kind, case when cid % 31 = 0 then 0 else count end as count, case when cid % 37 = 0 then 100 else price_cents end as price_cents,
  case when cid % 41 = 0 then '' when cid % 43 = 0 then ticker || ' ' else ticker end as ticker from quotes)
"""


def intent_validation(spark, sf_dir):
    why = orders.reject_reason(*map(F.col, ("strategy", "action", "side", "kind", "count", "price_cents", "ticker")))
    return _intents(spark, sf_dir).select(F.coalesce(why, F.lit("ok")).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def order_normalize(spark, sf_dir):
    i = _intents(spark, sf_dir).where("action in ('buy', 'sell') and side in ('yes', 'no') and kind in ('limit', 'market')")
    buy, yes = F.col("action") == "buy", F.col("side") == "yes"
    return i.select("cid", orders.is_bid(buy, yes).alias("is_bid"), orders.yes_cents(F.col("kind"), buy, yes, F.col("price_cents")).alias("yes_cents"))


def client_order_ids(spark, sf_dir):
    return view(spark, sf_dir, "quotes").select("cid", identity.client_order_id(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', place_ts)") * 1000, F.col("cid") % 30, F.col("cid")).alias("client_order_id"))


def fees_longest_prefix(spark, sf_dir):
    tape = view(spark, sf_dir, "tape")
    rates = fills.fee_rates(tape, view(spark, sf_dir, "fees"))
    fee = orders.fee_cents(F.col("maker_rate_e4"), F.col("size"), F.col("price_cents"))
    return tape.join(rates, "ticker").groupBy("ticker", "series_prefix", "maker_rate_e4").agg(F.sum(fee).alias("fee_cents"), F.count(F.lit(1)).alias("prints"))


def _filled(spark, sf_dir, tape, *tracks, latencies=(0,)):
    return fills.tracked(tape, fills.orders(view(spark, sf_dir, "quotes"), tracks, latencies))


def _fills(track):
    return lambda spark, sf_dir: _filled(spark, sf_dir, view(spark, sf_dir, "tape"), track).drop("track", "latency_days")


def fill_ineligible(spark, sf_dir):
    """Quotes that the queue track leaves out because the depth ahead of them is unknown."""
    return view(spark, sf_dir, "quotes").where("queue_ahead is null").groupBy("ticker").agg(F.count(F.lit(1)).alias("ineligible"), F.sum("count").alias("contracts"))


def _ledger(spark, sf_dir, track="strict"):
    tape = view(spark, sf_dir, "tape")
    rates = fills.fee_rates(tape, view(spark, sf_dir, "fees"))
    return tape, rates, fills.market_ledger(_filled(spark, sf_dir, tape, track), rates)


def market_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)[2]


def family_report(spark, sf_dir):
    """Settled PnL by family of the strict fills."""
    tape, rates, ledger = _ledger(spark, sf_dir)
    return fills.family_report(tape.select("ticker", "family").distinct(), ledger, view(spark, sf_dir, "settles"), rates)


def fill_rate(spark, sf_dir):
    """Filled over quoted contracts on each track."""
    quoted = view(spark, sf_dir, "quotes").agg(F.sum("count").alias("quoted"))
    all_ = _filled(spark, sf_dir, view(spark, sf_dir, "tape"), *fills.TRACKS).groupBy("track").agg(F.sum("qty").alias("filled"), F.count(F.lit(1)).alias("fills"))
    return all_.crossJoin(F.broadcast(quoted)).select("track", "filled", "fills", "quoted", F.round(F.col("filled") / F.col("quoted"), 6).alias("fill_rate"))  # one row


def speed_curve(spark, sf_dir):
    """The family report of the strict track for each latency."""
    tape, settles = view(spark, sf_dir, "tape"), view(spark, sf_dir, "settles")
    rates = fills.fee_rates(tape, view(spark, sf_dir, "fees"))
    filled = _filled(spark, sf_dir, tape, "strict", latencies=SPEEDS).withColumnRenamed("latency_days", "speed")
    markets = tape.select("ticker", "family").distinct().crossJoin(spark.createDataFrame([(s,) for s in SPEEDS], "speed int"))
    report = fills.family_report(markets, fills.market_ledger(filled, rates, "speed"), settles, rates, "speed")
    return report.groupBy("speed").agg(*(F.sum(c).alias(c) for c in ("gross_pnl_cents", "net_pnl_cents", "fills", "filled_contracts")))


def fill_markout(spark, sf_dir):
    tape = view(spark, sf_dir, "tape")
    out = fills.markout(_filled(spark, sf_dir, tape, "optimistic"), tape, HORIZON)
    return out.groupBy("ticker").agg(F.sum("markout_cents").alias("markout_sum"), F.sum("qty").alias("markout_n"), F.round(F.sum("markout_cents") / F.sum("qty"), 6).alias("avg_markout"))


def fill_markout_any(spark, sf_dir):
    tape = view(spark, sf_dir, "tape")
    out = fills.markout_any_market(_filled(spark, sf_dir, tape, "strict"), tape, HORIZON)
    return out.groupBy("ticker").agg(F.sum("markout_cents").alias("markout_sum"), F.sum("qty").alias("markout_n"))


def strategy_signals(spark, sf_dir):
    """Events to features to signals to intents, by side, and the signals whose trace leads to no event of a log that lost every 97th."""
    e = view(spark, sf_dir, "tape").withColumn("trace_id", F.col("tape_id"))
    f = extension.features(e, price=F.col("price_cents") - 50, size=F.col("size"), taker=F.when(F.col("taker_yes"), 1).otherwise(-1))
    s = extension.linear_model(f, [0.02, 0.01, 0.3], 0.9)
    lost = extension.orphans(s, e.where("trace_id % 97 <> 0")).agg(F.count(F.lit(1)).alias("orphans"))
    return s.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 3).alias("strength")).crossJoin(F.broadcast(lost))  # one row


def strategy_quarantine(spark, sf_dir):
    """A strategy that fails on prices over 90: three failures in a row shut off its market, the others go on."""

    def step(price):
        if price > 90:
            raise ValueError(price)
        return price / 100

    out = extension.quarantined(view(spark, sf_dir, "tape"), "ticker", "tape_id", step, "price_cents")
    return out.groupBy("key", "status").agg(F.count(F.lit(1)).alias("n"))


def quotes_from_tape(spark, sf_dir):
    return quotes.from_tape(view(spark, sf_dir, "tape"), 2).groupBy("ticker", "side").agg(F.count(F.lit(1)).alias("quotes"), F.sum("price_cents").alias("price_sum"), F.sum("until_tape_id").alias("until_sum"), F.count_if(F.col("until_tape_id").isNull()).alias("resting"))


def quotes_with_cap(spark, sf_dir):
    return quotes.with_cap(view(spark, sf_dir, "tape").select("ticker", "tape_id", "price_cents", "size", "taker_yes"), 2, 10, 25)


def _lifecycle(spark, sf_dir):
    """Open at placement, fills by print, cancellation: the events of each quote in order."""
    q = view(spark, sf_dir, "quotes")
    f = _filled(spark, sf_dir, view(spark, sf_dir, "tape"), "strict")
    return exposure.lifecycle(q, f)


def exposure_running(spark, sf_dir):
    return exposure.running(_lifecycle(spark, sf_dir)).groupBy("ticker").agg(F.max("at_risk_cents").alias("peak_at_risk"), F.max("open_contracts").alias("peak_open"), F.sum("d_risk").alias("end_risk"), F.count_if(F.col("at_risk_cents") > 100000).alias("over_cap"))


def exposure_total(spark, sf_dir):
    return exposure.daily_total(_lifecycle(spark, sf_dir))


def exposure_caps(spark, sf_dir):
    return exposure.caps(written(_lifecycle(spark, sf_dir), "lifecycle"), 50_000, 1_000_000)


LATE = 2  # days of latency


def lifecycle_audit(spark, sf_dir):
    """Steps between the seven states of orders on the queue track, with settlements, and with a fill behind the end of every 997th order (planted)."""
    q = view(spark, sf_dir, "quotes")
    day = F.timestamp_add("DAY", F.expr("cast(substr(ticker, 3) as int) * 20"), F.expr("timestamp_ntz'1997-01-01 00:00:00'"))
    settles = view(spark, sf_dir, "settles").withColumn("settle_ts", day)
    filled = fills.tracked(view(spark, sf_dir, "tape"), fills.orders(q, ("queue",), (LATE,), settles))
    own = q.join(settles.select("ticker", "settle_ts"), "ticker", "left").withColumn("latency_days", F.lit(LATE)).withColumn("ineligible", F.col("queue_ahead").isNull())
    log = exposure.states(own, filled)
    fault = q.where("cid % 997 = 5").select("cid", (F.col("place_ts") + F.expr("interval 10000 day")).alias("at"), F.lit(9).alias("rank"), F.lit("Filled").alias("state"))
    return exposure.audit(log.unionByName(fault))


# SQL ----------------------------------------------------------------------------------------------------------------------
def _met_sql(name: str = "met", latency: int = 0) -> str:
    w = f"interval {latency} day"
    return f"""{name} as (select q.*, t.tape_id, t.price_cents as q, t.size, t.ts as print_ts from quotes q join tape t on q.ticker = t.ticker
  and t.ts >= q.place_ts + {w} and (q.cancel_ts is null or t.ts < q.cancel_ts + {w})
  and ((q.buy_yes and not t.taker_yes and t.price_cents <= q.price_cents) or (not q.buy_yes and t.taker_yes and t.price_cents >= q.price_cents)))"""


def _fills_sql(track: str, met: str = "met", name: str = "f") -> str:
    if track == "queue":
        src = f"""(select *, case when q = price_cents then greatest(0, size - ahead) when ahead = 0 then size else 0 end as avail from (
    select *, greatest(0, queue_ahead - coalesce(sum(case when q = price_cents then size else 0 end) over (partition by cid order by tape_id rows between unbounded preceding and 1 preceding), 0)) as ahead
    from {met} where queue_ahead is not null))"""
    else:
        src = f"(select *, {'case when q = price_cents then 0 else size end' if track == 'strict' else 'size'} as avail from {met})"
    return f"""{name} as (select * from (select cid, ticker, tape_id, print_ts as ts, price_cents, buy_yes,
    cast(least(sum(avail) over w, count) - least(sum(avail) over w - avail, count) as bigint) as qty from {src} where avail > 0 window w as (partition by cid order by tape_id)) where qty > 0)"""


_RATES = """r as (select ticker, case when maker_rate_e4 >= 0 then maker_rate_e4 end as maker_rate_e4, case when maker_rate_e4 >= 0 then series_prefix end as series_prefix from (
  select t.ticker, f.*, row_number() over (partition by t.ticker order by length(series_prefix) desc, pos desc) as k from (select distinct ticker from tape) t left join fees f on starts_with(t.ticker, series_prefix)) where k = 1)"""
_FEE = "(cast(maker_rate_e4 as bigint) * qty * price_cents * (100 - price_cents) + 999999) // 1000000"
_LEDGER = f"""l as (select ticker, cast(sum(case when buy_yes then qty else 0 end) as bigint) as bought, cast(sum(case when buy_yes then qty * price_cents else 0 end) as bigint) as bought_cents,
  cast(sum(case when buy_yes then 0 else qty end) as bigint) as sold, cast(sum(case when buy_yes then 0 else qty * price_cents end) as bigint) as sold_cents, count(*) as fills, cast(sum({_FEE}) as bigint) as fee_cents
  from f left join r using (ticker) group by ticker)"""
_FAMILY = """select family, count(*) as markets, count(yes_wins) as settled_markets, cast(sum(gross) as bigint) as gross_pnl_cents,
  cast(sum(case when yes_wins is not null and rate is not null then fee else 0 end) as bigint) as fee_cents, cast(sum(case when yes_wins is not null and rate is not null then gross - fee else 0 end) as bigint) as net_pnl_cents,
  count(*) filter (yes_wins is not null and rate is null and n > 0) as excluded_fee_unknown, cast(sum(fills) as bigint) as fills, cast(sum(n) as bigint) as filled_contracts
from (select family, yes_wins, r.maker_rate_e4 as rate, coalesce(fee_cents, 0) as fee, coalesce(fills, 0) as fills, coalesce(bought, 0) + coalesce(sold, 0) as n,
  case when yes_wins is null then 0 else (coalesce(bought, 0) * (case when yes_wins then 100 else 0 end) - coalesce(bought_cents, 0)) + (coalesce(sold_cents, 0) - coalesce(sold, 0) * (case when yes_wins then 100 else 0 end)) end as gross
  from (select distinct ticker, family from tape) m left join l using (ticker) left join settles using (ticker) left join r using (ticker)) group by family"""
_TAPE = "tape quotes settles fees"
_PARSE = "regexp_full_match(s, '([0-9]+(\\.[0-9]{0,%d})?|\\.[0-9]{1,%d})')"


def _scaled_sql(s: str, d: int) -> str:
    return f"case when regexp_full_match({s}, '([0-9]+(\\.[0-9]{{0,{d}}})?|\\.[0-9]{{1,{d}}})') and length({s}) <= 24 then cast(('0' || split_part({s}, '.', 1)) as bigint) * {10**d} + cast(rpad(split_part({s}, '.', 2), {d}, '0') as bigint) end"


_LIFE = f""", {_met_sql()}, {_fills_sql('strict')},
ev as (select cid, ticker, place_ts as ts, 0 as step, 0 as tape_id, 'open' as event, count as d, price_cents, buy_yes from quotes
  union all select cid, ticker, ts, 1, tape_id, 'fill', -qty, price_cents, buy_yes from f
  union all select cid, ticker, cancel_ts, 2, 0, 'cancel', -(count - coalesce(done, 0)), price_cents, buy_yes from quotes left join (select cid, sum(qty) as done from f group by cid) using (cid) where cancel_ts is not null and count > coalesce(done, 0)),
rk as (select *, d * (case when buy_yes then price_cents else 100 - price_cents end) as d_risk from ev)
"""

QUERIES = {
    "entity_ids": entity_ids, "entity_collisions": entity_collisions, "fixed_point_parse": fixed_point_parse, "fixed_point_format": fixed_point_format, "intent_validation": intent_validation,
    "order_normalize": order_normalize, "client_order_ids": client_order_ids, "fees_longest_prefix": fees_longest_prefix, **{f"fills_{t}": _fills(t) for t in fills.TRACKS}, "fill_ineligible": fill_ineligible,
    "market_ledger": market_ledger, "family_report": family_report, "fill_rate": fill_rate, "speed_curve": speed_curve, "fill_markout": fill_markout, "fill_markout_any": fill_markout_any, "strategy_signals": strategy_signals, "strategy_quarantine": strategy_quarantine, "quotes_from_tape": quotes_from_tape, "quotes_with_cap": quotes_with_cap,
    "exposure_running": exposure_running, "exposure_total": exposure_total, "exposure_caps": exposure_caps, "lifecycle_audit": lifecycle_audit,
}

ORACLE_SQL = {
    "entity_ids": with_views("tape", f"select ticker, {fnv_sql('1', 'ticker')} as entity_id from (select distinct ticker from tape)"),
    "strategy_quarantine": with_views("tape", """, b as (select ticker, tape_id, price_cents > 90 as bad, count(*) filter (price_cents > 90) over (partition by ticker order by tape_id rows between 2 preceding and current row) as last3 from tape),
o as (select ticker, min(tape_id) filter (last3 = 3) as off from b group by 1)
select ticker as key, case when tape_id > coalesce(off, 1e18::bigint) then 'quarantined' when bad then 'ValueError' else 'ok' end as status, count(*) as n from b join o using (ticker) group by 1, 2"""),
    "entity_collisions": with_views("tape", "select 0 as collisions, 8 * count(distinct ticker) as keys from tape"),
    "fixed_point_parse": with_views("tape", _TEXTS + f"select tape_id, s, case when {_scaled_sql('s', 4)} <= 10000 then cast({_scaled_sql('s', 4)} as int) end as price_e4, {_scaled_sql('s', 2)} as count_fp, case when s[1] = '-' then -({_scaled_sql('s[2:]', 2)}) else {_scaled_sql('s', 2)} end as delta_fp from texts"),
    "fixed_point_format": with_views("tape", "select tape_id, printf('%d.%04d', e // 10000, e % 10000) as price, (case when fp < 0 then '-' else '' end) || printf('%d.%02d', abs(fp) // 100, abs(fp) % 100) as count, price_cents * 100 as e4, (e + 50) // 100 as cents from (select *, price_cents * 100 + cast(tape_id % 100 as int) as e, size * (case when taker_yes then 7 else -7 end) as fp from tape)"),
    "intent_validation": with_views("quotes", _INTENTS + """select case when strategy < 0 or strategy >= 30 then 'bad strategy_id' when action not in ('buy', 'sell') then 'bad action' when side not in ('yes', 'no') then 'bad side' when kind not in ('limit', 'market') then 'bad type'
  when count <= 0 then 'bad count' when kind = 'limit' and (price_cents < 1 or price_cents > 99) then 'bad price' when ticker = '' then 'empty ticker' when not regexp_full_match(ticker, '[A-Za-z0-9._-]+') then 'bad ticker char' else 'ok' end as verdict, count(*) as n from intents group by 1"""),
    "order_normalize": with_views("quotes", _INTENTS + """select cid, (action = 'buy') = (side = 'yes') as is_bid, case when kind = 'market' then case when (action = 'buy') = (side = 'yes') then 99 else 1 end when side = 'yes' then price_cents else 100 - price_cents end as yes_cents
from intents where action in ('buy', 'sell') and side in ('yes', 'no') and kind in ('limit', 'market')"""),
    "client_order_ids": with_views("quotes", "select cid, a[1:8] || '-' || a[9:12] || '-' || a[13:16] || '-' || b[1:4] || '-' || b[5:16] as client_order_id from (select cid, printf('%016x', epoch_us(place_ts) * 1000) as a, printf('%02x%014x', cid % 30, cid) as b from quotes)"),
    "fees_longest_prefix": with_views("tape fees", f", {_RATES} select ticker, series_prefix, maker_rate_e4, cast(sum({_FEE.replace('qty', 'size')}) as bigint) as fee_cents, count(*) as prints from tape join r using (ticker) group by all"),
    **{f"fills_{t}": with_views("tape quotes", f", {_met_sql()}, {_fills_sql(t)} select * from f") for t in fills.TRACKS},
    "fill_ineligible": with_views("quotes", "select ticker, count(*) as ineligible, cast(sum(count) as bigint) as contracts from quotes where queue_ahead is null group by ticker"),
    "market_ledger": with_views(_TAPE, f", {_met_sql()}, {_fills_sql('strict')}, {_RATES}, {_LEDGER} select * from l"),
    "family_report": with_views(_TAPE, f", {_met_sql()}, {_fills_sql('strict')}, {_RATES}, {_LEDGER} {_FAMILY}"),
    "fill_rate": with_views("tape quotes", f", {_met_sql()}, {', '.join(_fills_sql(t, name=t + '_f') for t in fills.TRACKS)} select track, cast(filled as bigint) as filled, fills, quoted, round(filled / quoted, 6) as fill_rate from ({' union all '.join(f'select {chr(39)}{t}{chr(39)} as track, sum(qty) as filled, count(*) as fills from {t}_f' for t in fills.TRACKS)}), (select cast(sum(count) as bigint) as quoted from quotes)"),
    "speed_curve": " union all ".join(f"select {s} as speed, cast(sum(gross_pnl_cents) as bigint) as gross_pnl_cents, cast(sum(net_pnl_cents) as bigint) as net_pnl_cents, cast(sum(fills) as bigint) as fills, cast(sum(filled_contracts) as bigint) as filled_contracts from ({with_views(_TAPE, f', {_met_sql(latency=s)}, {_fills_sql(chr(115) + "trict")}, {_RATES}, {_LEDGER} {_FAMILY}')})" for s in SPEEDS),
    "fill_markout": with_views("tape quotes", f""", {_met_sql()}, {_fills_sql('optimistic')}, firsts as (select ticker, ts, arg_min(price_cents, tape_id) as ref from tape group by ticker, ts)
select ticker, cast(sum(d * qty) as bigint) as markout_sum, cast(sum(qty) as bigint) as markout_n, round(sum(d * qty) / sum(qty), 6) as avg_markout from (
  select f.ticker, qty, case when buy_yes then ref - price_cents else price_cents - ref end as d from f asof join firsts p on f.ticker = p.ticker and f.ts + interval {HORIZON} day <= p.ts) group by ticker"""),
    "fill_markout_any": with_views("tape quotes", f""", {_met_sql()}, {_fills_sql('strict')}, firsts as (select ts, min(tape_id) as id from tape group by ts),
d as (select f.*, p.id from f asof join firsts p on f.ts + interval {HORIZON} day <= p.ts)
select ticker, cast(sum(x * qty) as bigint) as markout_sum, cast(sum(qty) as bigint) as markout_n from (select d.ticker, qty, case when buy_yes then t.price_cents - d.price_cents else d.price_cents - t.price_cents end as x from d asof join tape t on d.ticker = t.ticker and d.id >= t.tape_id) group by ticker"""),
    "strategy_signals": with_views("tape", """, x as (select tape_id, 0.02::double * (price_cents - 50) + 0.01::double * size + case when taker_yes then 0.3::double else -0.3::double end as s from tape)
select case when s > 0 then 'buy' else 'sell' end as side, count(*) as n, round(sum(abs(s)), 3) as strength, (select count(*) from x where abs(s) >= 0.9 and tape_id % 97 = 0) as orphans from x where abs(s) >= 0.9 group by 1"""),
    "exposure_running": with_views("tape quotes", _LIFE + """select ticker, max(at_risk)::bigint as peak_at_risk, max(open)::bigint as peak_open, sum(d_risk)::bigint as end_risk, count(*) filter (at_risk > 100000) as over_cap
from (select *, sum(d_risk) over w as at_risk, sum(d) over w as open from rk window w as (partition by ticker order by ts, step, tape_id, cid)) group by ticker"""),
    "exposure_total": with_views("tape quotes", _LIFE + "select cast(day as varchar) as day, cast(sum(r) over (order by day) as bigint) as at_risk_cents, cast(sum(o) over (order by day) as bigint) as open_contracts from (select cast(ts as date) as day, sum(d_risk) as r, sum(d) as o from rk group by 1)"),
    "exposure_caps": with_views("tape quotes", _LIFE + """, m as (select cast(ts as date) as day, ticker, sum(d_risk) over (partition by ticker order by ts, step, tape_id, cid) as r from rk), o as (select day, count(distinct ticker) filter (r > 50000) as markets_over from m group by day),
t as (select day, sum(r) over (order by day) as r from (select cast(ts as date) as day, sum(d_risk) as r from rk group by 1)) select cast(day as varchar) as day, cast(r as bigint) as at_risk_cents, markets_over, r > 1000000 as total_over from t join o using (day)"""),
    "lifecycle_audit": with_views("tape quotes settles", f""", z as (select ticker, timestamp '1997-01-01' + to_days(cast(substr(ticker, 3) as int) * 20) as settle_ts from settles),
o as (select quotes.*, settle_ts, place_ts + interval {LATE} day as active from quotes left join z using (ticker)),
q2 as (select * replace (case when settle_ts >= active and (cancel_ts is null or settle_ts - interval {LATE} day < cancel_ts) then settle_ts - interval {LATE} day else cancel_ts end as cancel_ts) from o),
{_met_sql("met", LATE).replace("from quotes q", "from q2 q")}, {_fills_sql("queue")},
full_ as (select cid, arg_max(ts, tape_id) as tm, sum(qty) as done from f group by cid),
ev as (select cid, place_ts as tm, 0 as rk, 'PendingNew' as st from o union all select cid, active, 1, 'Open' from o union all select cid, active, 2, 'Expired' from o where queue_ahead is null
  union all select cid, greatest(cancel_ts, active), 2, 'PendingCancel' from o where cancel_ts is not null union all select cid, cancel_ts + interval {LATE} day, 3, 'Canceled' from o where cancel_ts is not null
  union all select cid, settle_ts, 4, case when cancel_ts is not null and greatest(cancel_ts, active) <= settle_ts then 'Canceled' else 'Expired' end from o where active <= settle_ts
  union all select o.cid, full_.tm, 5, 'Filled' from o join full_ using (cid) where done >= count),
dead as (select *, min(case when st in ('Filled', 'Canceled', 'Expired') then epoch_us(tm)::hugeint * 10 + rk end) over (partition by cid) as stop from ev),
log as (select cid, tm, rk, st from dead where stop is null or epoch_us(tm)::hugeint * 10 + rk <= stop union all select cid, place_ts + interval 10000 day, 9, 'Filled' from quotes where cid % 997 = 5),
step as (select coalesce(lag(st) over (partition by cid order by tm, rk), 'Free') as was, st as state from log)
select was, state, count(*) as n, was || '>' || state not in ('Free>PendingNew', 'PendingNew>Open', 'Open>PendingCancel', 'Open>Filled', 'Open>Expired', 'PendingCancel>Canceled', 'PendingCancel>Filled') as illegal from step group by 1, 2"""),
    "quotes_from_tape": with_views("tape", """, t as (select *, side, case when side = 'ask' then price_cents + 2 else price_cents - 2 end as target from tape, (values ('ask'), ('bid')) s(side)),
v as (select * from t where case when side = 'ask' then target between 2 and 99 else target between 1 and 98 end),
c as (select * from (select *, lag(target) over (partition by ticker, side order by tape_id) as was from v) where was is null or was <> target),
n as (select *, lead(tape_id) over (partition by ticker, side order by tape_id) as until_tape_id from c)
select ticker, side, count(*) as quotes, cast(sum(target) as bigint) as price_sum, cast(sum(until_tape_id) as bigint) as until_sum, count(*) - count(until_tape_id) as resting from n group by ticker, side"""),
}
