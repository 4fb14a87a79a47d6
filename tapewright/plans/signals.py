"""Signal features over the views. Only specified, never published: the formulas and thresholds are ours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.operators import features, fills, policies, research, sequence, signals
from tapewright.plans.book import LEVELS, TOPS
from tapewright.plans.portable import oracle, over
from tapewright.plans.views import view, with_views

LEAD_HOURS = 24
SIZES = range(-7, 10)  # 1 + x % 9 of the view
K, BACK = 3, 5

_MID = "select event_id, ts, ticker, yes_bid as bid, yes_ask as ask, yes_bid + yes_ask as mid2 from {l1} where yes_bid is not null and yes_ask is not null"
_LAG = f"with m as ({_MID}), g as (select *, lag(bid) over w as bid0, lag(ask) over w as ask0, lag(mid2) over w as mid0, lead(mid2) over w as mid1, lag(ts) over w as ts0 from m window w as (partition by ticker order by ts, event_id)) "

#: The last ask of every leg at each update of its event, leg by leg.
ALIGNED = """with d as (select distinct ticker, event_ticker from {dim_market} where event_ticker is not null), u as (select d.event_ticker, l.event_id, l.ts from {l1} l join d using (ticker)),
x as (select u.*, d.ticker, q.yes_ask from u join d on d.event_ticker = u.event_ticker asof left join {l1} q on q.ticker = d.ticker and q.event_id <= u.event_id),
f as (select event_ticker, event_id, ts, count(*) as legs, count(yes_ask) as quoted, sum(yes_ask) as s from x group by 1, 2, 3)
"""
_SQL = {
    "sg_spread_net": oracle("select ticker, count(*) as n, cast(sum(yes_ask - yes_bid) as bigint) as spread_sum, sum(case when yes_ask - yes_bid - 2 > 0 then 1 else 0 end) as above_buffer from {l1} where yes_bid is not null and yes_ask is not null group by ticker"),
    "sg_flow_toxicity": oracle("with f as (select trade_id, ticker, case when taker_yes then size else -size end as s, size, ts from {trades}), w as (select ticker, sum(s) over (partition by ticker order by ts, trade_id rows between 9 preceding and current row) as flow, sum(size) over (partition by ticker order by ts, trade_id rows between 9 preceding and current row) as vol from f) select ticker, count(*) as n, round(avg(abs(cast(flow as double)) / vol), 6) as toxicity from w group by ticker"),
    "sg_state_regimes": oracle("with s as (select ticker, case when yes_ask - yes_bid <= 2 then 'tight' when yes_ask - yes_bid <= 4 then 'normal' when yes_ask - yes_bid is null then 'one_sided' else 'wide' end as regime, ts, event_id from {l1}), t as (select regime, lag(regime) over (partition by ticker order by ts, event_id) as was from s) select was, regime, count(*) as n from t where was is not null and was <> regime group by was, regime"),
    "sg_quote_lifetime": oracle("with d as (select ticker, lead(event_id) over (partition by ticker order by ts, event_id) - event_id as life from {l1}) select ticker, count(life) as n, min(life) as shortest, sum(case when life <= 5 then 1 else 0 end) as bursts from d group by ticker"),
    "sg_price_grid": oracle("select price_cents % 5 = 0 as round_number, price_cents % 10 as cell, count(*) as n, cast(sum(size) as bigint) as contracts from {trades} group by 1, 2"),
    "sg_seasonality": oracle("select cast(extract(hour from ts) as int) as hour, count(*) as n, round(avg(cast(yes_ask - yes_bid as double)), 6) as spread, count(distinct ticker) as markets from {l1} group by 1"),
    "sg_one_sided_gate": oracle("with d as (select ticker, case when yes_bid is null or yes_ask is null then 1 else 0 end as one, lead(ts) over (partition by ticker order by ts, event_id) as nxt, ts from {l1}) select ticker, sum(one) as one_sided, sum(case when one = 1 and nxt >= ts + interval 2 hour then 1 else 0 end) as held_2h from d group by ticker"),
    "sg_jump_no_trade": oracle(_LAG + ", t as (select ticker, ts from {trades}), j as (select g.ticker, g.event_id, g.ts, g.ts0 from g where abs(mid2 - mid0) >= 80) select j.ticker, count(*) as jumps, sum(case when n is null then 1 else 0 end) as without_trade from j left join (select j.ticker, j.event_id, count(*) as n from j join t on j.ticker = t.ticker and t.ts > j.ts0 and t.ts <= j.ts group by j.ticker, j.event_id) x on j.ticker = x.ticker and j.event_id = x.event_id group by j.ticker"),
    "sg_momentum": oracle(_LAG + "select ticker, count(*) as n, sum(case when (mid2 - mid0) * (mid1 - mid2) > 0 then 1 else 0 end) as continued, sum(case when (mid2 - mid0) * (mid1 - mid2) < 0 then 1 else 0 end) as reverted from g where mid0 is not null and mid1 is not null group by ticker"),
    "sg_post_jump": oracle(_LAG + "select mid2 > mid0 as up, count(*) as jumps, cast(sum(mid1 - mid2) as bigint) as forward_half_cents from g where abs(mid2 - mid0) >= 100 and mid1 is not null group by 1"),
    "sg_ofi": oracle(_LAG + "select ticker, cast(sum(case when bid > bid0 then 1 when bid < bid0 then -1 else 0 end - case when ask < ask0 then 1 when ask > ask0 then -1 else 0 end) as bigint) as ofi, count(*) as n from g where bid0 is not null group by ticker"),
    "sg_listing_drift": oracle("with f as (select ticker, min(ts) as listed from {trades} group by ticker) select cast(least(9, datediff(day, cast(listed as date), cast(ts as date))) as int) as age_day, count(*) as n, round(avg(cast(price_cents as double)), 6) as mean_price from {trades} t join f using (ticker) group by 1"),
    "sg_realized_vol": oracle(_LAG + "select ticker, extract(hour from ts) < 12 as morning, count(*) as n, cast(sum((mid2 - mid0) * (mid2 - mid0)) as bigint) as sum_sq from g where mid0 is not null group by 1, 2"),
    "sg_jump_hazard": oracle(_LAG + ", r as (select ticker, event_id, ts, sum(case when abs(mid2 - mid0) >= 80 then 1 else 0 end) over (partition by ticker order by ts, event_id rows between 10 preceding and 1 preceding) as recent, case when abs(mid2 - mid0) >= 80 then 1 else 0 end as jump from g where mid0 is not null) select recent, count(*) as at_risk, sum(jump) as jumps, round(cast(sum(jump) as double) / count(*), 6) as hazard from r where recent is not null group by recent"),
    "sg_high_ask": oracle("select t.ticker, count(*) as n, sum(case when yes_wins then 1 else 0 end) as wins from {tape} t join {settles} s on t.ticker = s.ticker where price_cents between 97 and 98 group by t.ticker"),
    "sg_overround": oracle(ALIGNED + """select event_ticker, cast(cast(ts as date) as varchar(10)) as day, count(*) as n, max(legs) as legs, cast(min(s - 100) as bigint) as least, cast(max(s - 100) as bigint) as most, cast(sum(s - 100) as bigint) as total, 'NOT_ESTIMABLE' as state
from f where legs > 1 and quoted = legs group by 1, 2"""),
    "sg_monotonicity": oracle("with a as (select m.event_ticker, t.ticker, cast(substr(t.ticker, 3) as int) as strike, avg(cast(price_cents as double)) as p from {trades} t join {dim_market} m on m.ticker = t.ticker where m.event_ticker is not null group by 1, 2, 3), b as (select *, lag(p) over (partition by event_ticker order by strike) as below from a) select event_ticker, count(*) as legs, sum(case when p > below then 1 else 0 end) as breaches from b group by event_ticker"),
    "sg_calibration": oracle("select cast(floor(price_cents / 10.0e0) as int) as band, count(*) as n, round(avg(case when yes_wins then 1.0e0 else 0.0e0 end), 6) as win_rate, round(avg((price_cents / 100.0e0 - case when yes_wins then 1.0e0 else 0.0e0 end) * (price_cents / 100.0e0 - case when yes_wins then 1.0e0 else 0.0e0 end)), 6) as brier from {tape} t join {settles} s on t.ticker = s.ticker group by 1"),
    "sg_rfq_survival": oracle("""with o as (select req_id, account, ts, case method when 'POST' then 1 else -1 end as d from {requests} where method in ('POST', 'DELETE')),
b as (select *, sum(d) over w as balance, count(*) filter (d > 0) over w as born from o window w as (partition by account order by ts, req_id rows between unbounded preceding and current row)),
m as (select *, min(balance) over (partition by account order by ts, req_id rows between unbounded preceding and 1 preceding) as low from b),
e as (select *, row_number() over (partition by account order by ts, req_id) as k from m where d < 0 and balance >= least(0, coalesce(low, 0))),
l as (select case when b.account % 2 = 0 then 'even' else 'odd' end as side, date_diff('microsecond', b.ts, coalesce(e.ts, (select max(ts) from o))) // 43200000000 as half_days, e.ts is null as open from b left join e on e.account = b.account and e.k = b.born where b.d > 0),
n as (select side, half_days, count(*) filter (not open) as ended, count(*) as n from l group by 1, 2), r as (select *, sum(n) over (partition by side order by half_days desc) as at_risk from n)
select side, half_days, cast(at_risk as bigint) as at_risk, ended, round(case when max(case when ended >= at_risk then 1 else 0 end) over w = 1 then 0.0 else exp(sum(case when ended < at_risk then ln(1 - ended / at_risk) end) over w) end, 6) as lasting from r window w as (partition by side order by half_days)"""),
    "sg_rfq_census": oracle("select account, count(*) as rfqs, case when count(*) < 60 then 'small' when count(*) < 75 then 'medium' else 'large' end as bucket, min(req_id) as first_id from {requests} where method = 'POST' group by account"),
    "sg_readiness": oracle("with a as (select ticker, count(*) as n_rows, count(distinct cast(ts as date)) as days, sum(case when yes_bid is not null and yes_ask is not null then 1 else 0 end) as two_sided from {l1} group by ticker) select ticker, days >= 10 and two_sided * 10 >= n_rows * 8 as ready, days, two_sided from a"),
    "sg_composite_rank": oracle("with a as (select ticker, count(*) as n, cast(sum(size) as bigint) as v from {trades} group by ticker) select ticker, round(percent_rank() over (order by n) * 0.5e0 + percent_rank() over (order by v) * 0.5e0, 6) as score from a"),
    "sg_thin_gate": oracle("with a as (select ticker, datediff(day, cast(min(ts) as date), cast(max(ts) as date)) as age, count(*) as n, avg(cast(yes_ask - yes_bid as double)) as spread from {l1} group by ticker) select ticker, age >= 20 and n < 600 and spread > 3 as thin from a"),
    "sg_lifecycle_census": oracle("with p as (select cast(user_id as varchar(10)) as who, max(case when event_type = 'signup' then 1 else 0 end) as a, max(case when event_type = 'purchase' then 1 else 0 end) as b, max(case when event_type = 'error' then 1 else 0 end) as c from (select account as user_id, case method when 'GET' then 'signup' when 'DELETE' then 'purchase' else 'error' end as event_type from {requests}) x group by user_id) select a, b, c, count(*) as n from p group by a, b, c"),
    "sg_intent_overlap": oracle("with q as (select cid, ticker, place_ts, coalesce(cancel_ts, place_ts + interval 30 day) as until, count from {quotes}), n as (select ticker, cid, place_ts, max(until) over (partition by ticker order by place_ts, cid rows between unbounded preceding and 1 preceding) as busy from q) select ticker, count(*) as intents, sum(case when place_ts < busy then 1 else 0 end) as overlapping from n group by ticker"),
    "market_change_only": oracle("with p as (select *, row_number() over (partition by ticker order by ts, event_id) as k, lag(yes_bid) over (partition by ticker order by ts, event_id) as b0, lag(yes_ask) over (partition by ticker order by ts, event_id) as a0 from {l1}) select event_id, ticker, row_number() over (partition by ticker order by ts, event_id) as seq from p where k = 1 or b0 is distinct from yes_bid or a0 is distinct from yes_ask"),
    "trade_dedupe": oracle("with d as (select *, row_number() over (partition by trade_id order by ts) as k from (select * from {trades} union all select * from {trades} where trade_id % 3 = 0) x) select ticker, count(*) as seen, sum(case when k = 1 then 1 else 0 end) as kept from d group by ticker"),
}


# Jumps and moves are of twice the mid, in cents.

def _survival(spark, sf_dir):
    """How long requests stay open, in half days, by account parity: a deletion ends the oldest open one, the log's end censors the rest."""
    r = view(spark, sf_dir, "requests").where("method in ('POST', 'DELETE')").select("req_id", "account", "ts", F.when(F.col("method") == "POST", 1).otherwise(-1).alias("d"))
    end = r.agg(F.max("ts").alias("last"))
    x = features.lifetimes(r).crossJoin(F.broadcast(end))  # one row
    us = F.timestamp_diff("MICROSECOND", "ts", F.coalesce("end_ts", "last"))
    x = x.select(F.when(F.col("account") % 2 == 0, "even").otherwise("odd").alias("side"), F.floor(us / 43_200_000_000).alias("half_days"), F.col("end_ts").isNull().alias("open"))
    return research.kaplan_meier(x, "side", "half_days", "open")


_Q = {
    "sg_spread_net": over(features.spread_net, "l1", buffer=2),
    "sg_flow_toxicity": over(features.flow_toxicity, "trades", length=10),
    "sg_state_regimes": over(features.regime_changes, "l1", tight=2, normal=4),
    "sg_quote_lifetime": over(features.quote_lifetimes, "l1", burst=5),
    "sg_price_grid": over(features.price_grid, "trades"),
    "sg_seasonality": over(features.seasonality, "l1"),
    "sg_one_sided_gate": over(features.one_sided_gate, "l1", hours=2),
    "sg_jump_no_trade": over(features.jumps_without_trade, "l1", "trades", least=80),
    "sg_momentum": over(features.momentum, "l1"),
    "sg_post_jump": over(features.post_jump, "l1", least=100),
    "sg_ofi": over(features.flow_imbalance, "l1"),
    "sg_listing_drift": over(features.listing_drift, "trades", most_days=9),
    "sg_realized_vol": over(features.realized_vol, "l1"),
    "sg_jump_hazard": over(features.jump_hazard, "l1", least=80, length=10),
    "sg_high_ask": lambda spark, sf_dir: features.high_ask(_settled(spark, sf_dir), 97, 98),
    "sg_overround": over(features.overround, "l1", "dim_market"),
    "sg_monotonicity": over(features.monotonicity, "trades", "dim_market", strike="cast(substr(ticker, 3) as int)"),
    "sg_calibration": lambda spark, sf_dir: features.calibration(_settled(spark, sf_dir), 10),
    "sg_rfq_survival": _survival,
    "sg_rfq_census": over(features.rfq_census, "requests", small=60, medium=75),
    "sg_readiness": over(features.readiness, "l1", least_days=10, share=0.8),
    "sg_composite_rank": over(features.composite_rank, "trades"),
    "sg_thin_gate": over(features.thin_gate, "l1", days=20, rows=600, spread=3),
    "sg_lifecycle_census": over(features.lifecycle_census, "requests"),
    "sg_intent_overlap": over(features.intent_overlap, "quotes", default_days=30),
    "market_change_only": over(features.changes_only, "l1"),
    "trade_dedupe": lambda spark, sf_dir: features.deduplicated(_repeated(view(spark, sf_dir, "trades"))),
}


def _settled(spark, sf_dir):
    return features.settled(view(spark, sf_dir, "prints"), view(spark, sf_dir, "settles"))


def _repeated(trades):
    """A feed that sends a third of its trades twice."""
    return trades.union(trades.where("trade_id % 3 = 0"))


def _mids(spark, sf_dir):
    return view(spark, sf_dir, "l1").where("yes_bid is not null and yes_ask is not null").select("ticker", "event_id", "ts", (F.col("yes_bid") + F.col("yes_ask")).cast("double").alias("mid"))


def sg_cusum(spark, sf_dir):
    return signals.cusum(_mids(spark, sf_dir), 120.0, 5.0, 0.1)


def sg_capacity(spark, sf_dir):
    return signals.walked(sequence.levels(view(spark, sf_dir, "frames")).where("side = 'yes'").select("sid", "ticker", "price_cents", "size"), 20)


def sg_microprice(spark, sf_dir):
    """Distance of the size-weighted price from the mid, over the books that have both sides."""
    return features.displacement(sequence.best_sizes(sequence.levels(view(spark, sf_dir, "frames"))))


def sg_depth_imbalance(spark, sf_dir):
    lv = sequence.levels(view(spark, sf_dir, "frames"))
    y, n = (F.coalesce(F.sum(F.when(F.col("side") == s, F.col("size"))), F.lit(0)) for s in ("yes", "no"))
    return lv.groupBy("sid", "ticker").agg(y.alias("yes_depth"), n.alias("no_depth"), F.round((y - n) / (y + n), 6).alias("imbalance"))


def _features(spark, sf_dir):
    t = view(spark, sf_dir, "tape").join(view(spark, sf_dir, "settles"), "ticker")
    return t.select("tape_id", "ticker", "ts", F.col("price_cents").cast("double").alias("price"), F.col("size").cast("double").alias("size"), F.col("taker_yes").cast("double").alias("taker"), F.col("yes_wins").cast("double").alias("label"))


def sg_settlement_glm(spark, sf_dir):
    """Probability of settlement from a model fit on the trades before 1999, for those after."""
    out = signals.logistic(_features(spark, sf_dir), ["price", "size", "taker"], "label", "ts < timestamp_ntz'1999-01-01 00:00:00'")
    return out.where("ts >= timestamp_ntz'1999-01-01 00:00:00'").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("won"))


def sg_factors(spark, sf_dir):
    f = _features(spark, sf_dir).groupBy("ticker").agg(F.avg("price").alias("price"), F.avg("size").alias("size"), F.avg("taker").alias("taker"))
    return signals.components(f, ["price", "size", "taker"], 2)


def sg_lead_lag(spark, sf_dir):
    """Linked are the markets of one event of the dimension."""
    d = view(spark, sf_dir, "dim_market").where("event_ticker is not null")
    links = d.select("event_ticker", F.col("ticker").alias("leader")).join(d.select("event_ticker", F.col("ticker").alias("follower")), "event_ticker").where("leader <> follower")
    return policies.lead_lag(view(spark, sf_dir, "l1"), links, LEAD_HOURS)


def sg_large_flow(spark, sf_dir):
    """Price response by whether a trade is in the top tenth of the earlier ones; null for those without earlier ones."""
    nxt = F.lead("price_cents").over(Window.partitionBy("ticker").orderBy("ts", "trade_id"))
    t = policies.past_rank(view(spark, sf_dir, "trades"), SIZES).withColumn("nxt", nxt).where("nxt is not null")
    way = F.when(F.col("taker_yes"), 1).otherwise(-1)
    return t.groupBy((F.col("past_rank") >= 0.9).alias("large")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("nxt") - F.col("price_cents")) * way).alias("response"))


def _prints(spark, sf_dir):
    """Prints with the result of their market and the taker's rate; the policy buys what takers buy."""
    tape, fees = view(spark, sf_dir, "tape"), view(spark, sf_dir, "fees")
    rates = fills.fee_rates(tape, fees.withColumn("maker_rate_e4", F.col("taker_rate_e4"))).select("ticker", F.col("maker_rate_e4").alias("taker_rate_e4"))
    t = tape.join(rates, "ticker", "left").join(view(spark, sf_dir, "settles"), "ticker", "left")
    return t.select("ticker", F.col("ts").cast("date").alias("day"), "price_cents", "size", F.col("taker_yes").alias("taken"), "yes_wins", "taker_rate_e4")


def sg_policy_pnl(spark, sf_dir):
    return policies.policy_days(_prints(spark, sf_dir), view(spark, sf_dir, "dim_market").select("ticker", "event_ticker"))


def sg_capital_return(spark, sf_dir):
    return policies.capital_return(_prints(spark, sf_dir))


def sg_retreat(spark, sf_dir):
    """A side retreats where at least two of its K best levels lost depth and their depth fell; both may at once."""
    yes, no = ((F.col(f"{s}_lost") >= 2) & (F.col(f"{s}_change") < 0) for s in ("yes", "no"))
    x = sequence.retreats(view(spark, sf_dir, "frames"), K, BACK)
    return x.groupBy("sid", "ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(yes & ~no).alias("yes_retreats"), F.count_if(no & ~yes).alias("no_retreats"), F.count_if(yes & no).alias("both"), F.sum(F.col("yes_change") + F.col("no_change")).alias("depth_change"))


QUERIES = {f.__name__: f for f in (sg_cusum, sg_capacity, sg_microprice, sg_depth_imbalance, sg_settlement_glm, sg_factors)} | _Q
QUERIES |= {f.__name__: f for f in (sg_lead_lag, sg_large_flow, sg_policy_pnl, sg_capital_return, sg_retreat)}
ORACLE_SQL = {k: s.replace("datediff(day,", "datediff('day',") for k, s in _SQL.items()}

_TAKER = """rt as (select ticker, case when taker_rate_e4 >= 0 then taker_rate_e4 end as rate from (select t.ticker, f.taker_rate_e4, row_number() over (partition by t.ticker order by length(series_prefix) desc, pos desc) as k
  from (select distinct ticker from tape) t left join fees f on starts_with(t.ticker, series_prefix)) where k = 1),
pr as (select t.ticker, cast(t.ts as date) as day, price_cents, size, taker_yes, cast(size as bigint) * price_cents as cap,
  size * (case when yes_wins then 100 when not yes_wins then 0 end - price_cents) - (cast(rate as bigint) * size * price_cents * (100 - price_cents) + 999999) // 1000000 as net
  from tape t left join rt using (ticker) left join settles using (ticker))"""
_TOPS = TOPS + f""",
dep as (select sid, ticker, segment, i, sum(size) filter (side = 'yes') as y, sum(size) filter (side = 'no') as n from top group by all),
cmp as (select msg.sid, msg.ticker, msg.segment, msg.i, greatest(1, msg.i - {BACK}) as w from msg where msg.i > 1),
los as (select cmp.sid, cmp.ticker, cmp.segment, cmp.i, count(*) filter (t.side = 'yes' and coalesce(s.size, 0) < t.size) as yl, count(*) filter (t.side = 'no' and coalesce(s.size, 0) < t.size) as nl
  from cmp join top t on t.sid = cmp.sid and t.ticker = cmp.ticker and t.segment = cmp.segment and t.i = cmp.w
  join sz s on s.sid = cmp.sid and s.ticker = cmp.ticker and s.segment = cmp.segment and s.i = cmp.i and s.side = t.side and s.price_cents = t.price_cents group by all),
ch as (select cmp.sid, cmp.ticker, coalesce(a.y, 0) - coalesce(b.y, 0) as yc, coalesce(a.n, 0) - coalesce(b.n, 0) as nc, coalesce(yl, 0) as yl, coalesce(nl, 0) as nl from cmp
  left join dep a on a.sid = cmp.sid and a.ticker = cmp.ticker and a.segment = cmp.segment and a.i = cmp.i left join dep b on b.sid = cmp.sid and b.ticker = cmp.ticker and b.segment = cmp.segment and b.i = cmp.w
  left join los on los.sid = cmp.sid and los.ticker = cmp.ticker and los.segment = cmp.segment and los.i = cmp.i)
"""
ORACLE_SQL |= {
    "sg_cusum": with_views("l1", """, m as (select ticker, event_id, cast(yes_bid + yes_ask as double) as mid, row_number() over (partition by ticker order by ts, event_id) as k from l1 where yes_bid is not null and yes_ask is not null),
w as (select ticker, event_id, k, mid, 0::double as up, 0::double as down, 0::double as var, false as hit from m where k = 1
union all select ticker, event_id, k, mid, case when h then 0 else u end, case when h then 0 else d end, v, h from (select *, u > 120 or d > 120 as h from (
  select m.ticker, m.event_id, m.k, m.mid, greatest(0, w.up + (m.mid - w.mid) - 5) as u, greatest(0, w.down - (m.mid - w.mid) - 5) as d, 0.1::double * (m.mid - w.mid) * (m.mid - w.mid) + 0.9::double * w.var as v from w join m on m.ticker = w.ticker and m.k = w.k + 1)))
select ticker, event_id, hit as change_point, var as ewma_var from w""").replace("with ", "with recursive ", 1),
    "sg_microprice": with_views("frames", LEVELS + """, b as (select sid, ticker, max(price_cents) filter (side = 'yes') as bid, arg_max(size, price_cents) filter (side = 'yes') as bq, 100 - max(price_cents) filter (side = 'no') as ask, arg_max(size, price_cents) filter (side = 'no') as aq from lv group by 1, 2)
select ticker, count(*) as n, round(avg((bid * aq + ask * bq) / (bq + aq) - (bid + ask) / 2), 6) as displacement from b where bid is not null and ask is not null group by ticker"""),
    "sg_lead_lag": with_views("l1 dim_market", f""", q as (select ticker, event_id, ts, yes_bid + yes_ask as m from l1 where yes_bid is not null and yes_ask is not null),
a as (select *, m - lag(m) over w as d, min(ts) over (partition by ticker) as t0 from q window w as (partition by ticker order by ts, event_id)),
mv as (select ticker, event_id, ts, d, coalesce(lag(ts) over (partition by ticker order by ts, event_id), t0) as since from a where d <> 0),
ld as (select ticker, ts, arg_max(d, event_id) as ld from mv group by 1, 2),
x as (select a.event_ticker, a.ticker as leader, b.ticker as follower, f.ts, f.d, f.since from dim_market a join dim_market b on a.event_ticker = b.event_ticker and a.ticker <> b.ticker join mv f on f.ticker = b.ticker),
y as (select x.*, ld.ts as lts, ld.ld, date_diff('microsecond', ld.ts, x.ts) as age from x asof left join ld on x.leader = ld.ticker and x.ts > ld.ts),
z as (select *, coalesce(age <= {LEAD_HOURS} * 3600000000, false) as aged, coalesce(age <= {LEAD_HOURS} * 3600000000 and since < lts, false) as stale from y)
select event_ticker, leader, follower, count(*) as moves, count(*) filter (aged) as aged, count(*) filter (stale) as stale, count(*) filter (stale and (ld > 0) = (d > 0)) as same_way, count(*) filter (stale and (ld > 0) <> (d > 0)) as other_way, round(avg(age) filter (stale) / 1000000, 3) as mean_lag_s from z group by all"""),
    "sg_large_flow": with_views("trades", """, o as (select *, row_number() over (partition by ticker order by ts, trade_id) as k, lead(price_cents) over (partition by ticker order by ts, trade_id) as nxt from trades),
e as (select o.trade_id, count(u.k) as earlier, count(*) filter (u.size < o.size) as smaller from o left join o u on u.ticker = o.ticker and u.k < o.k group by 1)
select case when earlier > 0 then smaller / earlier >= 0.9 end as large, count(*) as n, cast(sum((nxt - price_cents) * case when taker_yes then 1 else -1 end) as bigint) as response from o join e using (trade_id) where nxt is not null group by 1"""),
    "sg_capital_return": with_views("tape settles fees", f""", {_TAKER},
o as (select ticker, day, 0 as step, sum(cap) as cap from pr where taker_yes group by 1, 2), z as (select ticker, max(day) as day from pr group by 1),
ev as (select * from o union all select o.ticker, z.day, 1, -sum(o.cap) from o join z using (ticker) group by 1, 2),
pk as (select ticker, max(c) as peak from (select ticker, sum(cap) over (partition by ticker order by day, step) as c from ev) group by 1),
tn as (select ticker, sum(cap) as turnover, case when count(net) = count(*) then sum(net) end as net from pr where taker_yes group by 1)
select ticker, cast(peak as bigint) as peak_capital, cast(turnover as bigint) as turnover, cast(net as bigint) as net_cents, round(net / peak, 6) as return from pk join tn using (ticker)"""),
    "sg_policy_pnl": with_views("tape settles fees dim_market", f""", {_TAKER},
sp as (select ticker, min(day) as d0, max(day) as d1 from pr group by 1), cal as (select ticker, cast(unnest(generate_series(d0, d1, interval 1 day)) as date) as day from sp),
dn as (select ticker, day, count(*) as opportunities, count(*) filter (taker_yes) as triggers, coalesce(sum(size) filter (taker_yes), 0) as contracts, coalesce(sum(cap) filter (taker_yes), 0) as cap,
  count(*) filter (taker_yes and net is null) as gaps, coalesce(sum(net) filter (taker_yes), 0) as net, count(*) filter (net is null) as base_gaps, sum(net) as base from pr group by 1, 2),
md as (select ticker, day, d.event_ticker, case when d.event_ticker is null then ticker end as market, coalesce(opportunities, 0) as opportunities, coalesce(triggers, 0) as triggers, coalesce(contracts, 0) as contracts, coalesce(cap, 0) as cap,
  case when coalesce(gaps, 0) = 0 then coalesce(net, 0) end as net, case when coalesce(base_gaps, 0) = 0 then coalesce(base, 0) end as base from cal left join dn using (ticker, day) left join dim_market d using (ticker)),
-- capital in use on a day: all bought so far in markets whose last day has not passed
op as (select a.event_ticker, a.market, a.day, sum(b.cap) as peak from (select distinct event_ticker, market, day from md) a join md b on b.event_ticker is not distinct from a.event_ticker and b.market is not distinct from a.market and b.day <= a.day join sp on sp.ticker = b.ticker and sp.d1 >= a.day group by 1, 2, 3)
select md.event_ticker, md.market, cast(md.day as varchar) as day, cast(case when count(net) = count(*) then sum(net) end as bigint) as net_cents, cast(case when count(base) = count(*) then sum(base) end as bigint) as baseline_cents,
  cast(case when count(net) = count(*) and count(base) = count(*) then sum(net) - sum(base) end as bigint) as delta_cents, cast(sum(opportunities) as bigint) as opportunities, cast(sum(triggers) as bigint) as triggers, cast(sum(triggers) as bigint) as fills, cast(sum(contracts) as bigint) as contracts, count(*) as market_days, cast(any_value(peak) as bigint) as peak_capital
from md join op on op.event_ticker is not distinct from md.event_ticker and op.market is not distinct from md.market and op.day = md.day group by 1, 2, 3"""),
    "sg_retreat": with_views("frames", LEVELS.rstrip() + ", " + _TOPS + """select sid, ticker, count(*) as n, count(*) filter (yl >= 2 and yc < 0 and not (nl >= 2 and nc < 0)) as yes_retreats, count(*) filter (nl >= 2 and nc < 0 and not (yl >= 2 and yc < 0)) as no_retreats,
  count(*) filter (yl >= 2 and yc < 0 and nl >= 2 and nc < 0) as both, cast(sum(yc + nc) as bigint) as depth_change from ch group by 1, 2"""),
}

ORACLE_SQL |= {
    "sg_capacity": with_views("frames", LEVELS + """, y as (select *, sum(size) over (partition by sid, ticker order by price_cents desc) as cum from lv where side = 'yes'), t as (select *, greatest(0, least(size, 20 - (cum - size))) as take from y)
select sid, ticker, cast(sum(take) as bigint) as filled, cast(sum(take * price_cents) as bigint) as proceeds, max(price_cents) as best from t group by 1, 2"""),
    "sg_depth_imbalance": with_views("frames", LEVELS + "select sid, ticker, cast(coalesce(sum(size) filter (side = 'yes'), 0) as bigint) as yes_depth, cast(coalesce(sum(size) filter (side = 'no'), 0) as bigint) as no_depth, round((coalesce(sum(size) filter (side = 'yes'), 0) - coalesce(sum(size) filter (side = 'no'), 0)) / sum(size), 6) as imbalance from lv group by 1, 2"),
}
