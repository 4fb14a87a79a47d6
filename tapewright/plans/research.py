"""Queries over top of book, trades, gaps and the market dimension."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators import features, research
from tapewright.operators.quantiles import quantiles
from tapewright.plans import book
from tapewright.plans.portable import oracle, over
from tapewright.plans.signals import ALIGNED
from tapewright.plans.views import load, view, with_views
from tapewright.sources.scratch import written

HORIZONS = (1, 5, 30)  # hours: the reference's seconds, scaled to the adapter's clock
TTLS = (15, 60, 300)  # minutes
WIDE, BINS, BIN_MINUTES = 3, 10, 60
CHANNELS = {"l1": ("l1", "event_id"), "trades": ("trades", "trade_id"), "l2": ("messages", "arrival")}
# Which source rows each channel is to hold, said apart from the views.
DECLARED = {"l1": "true", "trades": "event_type <=> 'purchase'", "l2": "not (event_id % 97 <=> 0)"}


def _v(spark, sf_dir, *names):
    return [view(spark, sf_dir, n) for n in names]


def trade_book_asof(spark, sf_dir):
    t, b = _v(spark, sf_dir, "trades", "l1")
    return research.as_of(t, b, F.col("ts"), True, "past").select("trade_id", "ticker", F.col("past.bid").alias("bid"), F.col("past.ask").alias("ask"), F.expr("timestampdiff(MICROSECOND, past.ts, ts)").alias("age_us"))


def _surface(spark, sf_dir):
    t, b, g = _v(spark, sf_dir, "trades", "l1", "gaps")
    x = research.past_and_future(t, b, HORIZONS).withColumn("span_end", F.col("ts") + F.expr("interval 1 hour")).withColumn("span_start", F.coalesce(F.col("past.ts"), F.col("ts")))
    return x, research.clear_of_gaps(x, g, "span_start", "span_end")


def trade_markout_surface(spark, sf_dir):
    """Mean signed move of the mid from the past book to each horizon, in half cents; by taker side."""
    _, clean = _surface(spark, sf_dir)
    sign = F.when(F.col("taker_yes"), 1).otherwise(-1)
    parts = [clean.select("taker_yes", F.lit(h).alias("horizon"), (sign * (research.mid2(f"f{h}") - research.mid2("past"))).alias("d")) for h in HORIZONS]
    x = parts[0].union(parts[1]).union(parts[2]).where("d is not null")
    return x.groupBy("horizon", "taker_yes").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("sum_half_cents"), F.round(F.sum("d") / F.count(F.lit(1)), 6).alias("mean_half_cents"))


def markout_waterfall(spark, sf_dir):
    """How many trades pass each step; each horizon starts from the gap-clean base."""
    x, clean = _surface(spark, sf_dir)
    flags = x.join(clean.select("trade_id", F.lit(True).alias("clean")), "trade_id", "left")
    has = research.mid2("past").isNotNull()
    ok = has & F.coalesce("clean", F.lit(False))
    one = flags.agg(F.count(F.lit(1)).alias("all"), F.count_if(has).alias("past"), F.count_if(ok).alias("clean"), *(F.count_if(ok & research.mid2(f"f{h}").isNotNull()).alias(f"h{h}") for h in HORIZONS))
    steps = "stack(6, 'all_trades', 'none', all, 0L, 'past_book', 'all_trades', past, all - past, 'gap_clean', 'past_book', clean, past - clean, " + ", ".join(f"'future_{h}h', 'gap_clean', h{h}, clean - h{h}" for h in HORIZONS) + ") as (step, base_step, n, excluded)"
    return one.selectExpr(steps)


def one_sided_exposure(spark, sf_dir):
    x = written(research.intervals(view(spark, sf_dir, "l1")).select("state", "dur_us"), "intervals")
    sums = x.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("dur_us").alias("exposure_us"), F.count_if(F.col("dur_us").isNull()).alias("censored"))
    q = quantiles(x, ("state",), "dur_us", {"p50_us": 0.5, "p95_us": 0.95}).drop("n")
    return sums.join(q, "state", "left").select("state", "n", "exposure_us", "censored", F.round("p50_us", 3).alias("p50_us"), F.round("p95_us", 3).alias("p95_us"))


def ttl_dwell(spark, sf_dir):
    return research.dwell(view(spark, sf_dir, "l1"), TTLS)


def _eps(spark, sf_dir):
    return research.episodes(view(spark, sf_dir, "l1"), WIDE)


def liquidity_episodes(spark, sf_dir):
    return _eps(spark, sf_dir).select("ticker", "first_id", "n", F.expr("timestampdiff(MICROSECOND, start_ts, last_ts)").alias("length_us"), F.expr("timestampdiff(MICROSECOND, start_ts, refill_ts)").alias("refill_us"))


def refill_hazard(spark, sf_dir):
    return research.hazard(_eps(spark, sf_dir), BINS, BIN_MINUTES)


def refill_survival(spark, sf_dir):
    return research.survival(research.hazard(_eps(spark, sf_dir), BINS, BIN_MINUTES, "ticker"), "ticker").select("ticker", "bin", "at_risk", "refilled")


def _matched(spark, sf_dir):
    l1 = view(spark, sf_dir, "l1")
    return research.matched(_eps(spark, sf_dir), l1.where(f"yes_ask - yes_bid < {WIDE} and yes_ask > yes_bid"), 24, 24)


def match_controls(spark, sf_dir):
    return _matched(spark, sf_dir).select("ticker", "episode", "control", "lag_us")


def match_coverage(spark, sf_dir):
    m, e = _matched(spark, sf_dir), _eps(spark, sf_dir)
    x = e.join(m.select(F.col("episode").alias("first_id"), "control"), "first_id", "left")
    return x.groupBy("ticker").agg(F.count(F.lit(1)).alias("episodes"), F.count("control").alias("matched"), (F.count(F.lit(1)) - F.count("control")).alias("unmatched"), F.round(F.count("control") / F.count(F.lit(1)), 6).alias("rate"))


def match_balance(spark, sf_dir):
    """Mean and 95th percentile of absolute differences, and the standardised mean difference (chosen: pooled by halves)."""
    t, c = F.col("ask0") - F.col("bid0"), F.col("cask") - F.col("cbid")
    m = written(_matched(spark, sf_dir).select("lag_us", t.alias("t"), c.alias("c"), F.abs(t - c).alias("d")), "balance")
    smd = (F.avg("t") - F.avg("c")) / F.sqrt((F.var_samp("t") + F.var_samp("c")) / 2)
    means = m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_abs"), F.round(smd, 6).alias("smd"))
    far, late = quantiles(m, (), "d", {"p95_abs": 0.95}).drop("n"), quantiles(m, (), "lag_us", {"median_lag_us": 0.5, "p95_lag_us": 0.95}).drop("n")
    out = means.join(far, F.lit(True), "left").join(late, F.lit(True), "left")  # one row each
    return out.select("n", "mean_abs", F.round("p95_abs", 6).alias("p95_abs"), "smd", F.round("median_lag_us", 3).alias("median_lag_us"), F.round("p95_lag_us", 3).alias("p95_lag_us"))


def match_concentration(spark, sf_dir):
    n = _matched(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("markets"), F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("hhi"), F.round(F.max("n") / F.sum("n"), 6).alias("max_share"))


def manifest(spark, sf_dir):
    """Declared rows of each channel by day, counted in the source table."""
    e = load(spark, sf_dir, "events")
    one, *more = (research.tally(e.where(rule), channel, "event_id") for channel, rule in DECLARED.items())
    return functools.reduce(DataFrame.unionByName, more, one)


def row_conservation(spark, sf_dir):
    """The views' rows against a manifest that is written before they are built."""
    declared = written(manifest(spark, sf_dir), "manifest")
    one, *more = (research.tally(view(spark, sf_dir, name), channel, id) for channel, (name, id) in CHANNELS.items())
    return research.conserved(declared, functools.reduce(DataFrame.unionByName, more, one))


_STATE = "case when yes_bid is not null and yes_ask is not null then case when yes_bid >= yes_ask then 'CROSSED' else 'TWO_SIDED' end when yes_bid is not null then 'BID_ONLY' when yes_ask is not null then 'ASK_ONLY' else 'NONE' end"
_FUT = ", ".join(f"f{h} as (select t.trade_id, b.ts as fts, b.yes_bid + b.yes_ask as m from trades t asof join l1 b on t.ticker = b.ticker and t.ts + interval {h} hour >= b.ts where b.ts > t.ts)" for h in HORIZONS)
_SURF = f""", p as (select t.*, b.ts as pts, b.yes_bid + b.yes_ask as m0 from trades t asof left join l1 b on t.ticker = b.ticker and t.ts > b.ts), {_FUT},
ok as (select * from p where not exists (select 1 from gaps where coalesce(pts, p.ts) < gap_end and p.ts + interval 1 hour > gap_start)),
j as (select {', '.join(f'f{h}.m as m{h}' for h in HORIZONS)}, ok.* from ok {' '.join(f'left join f{h} using (trade_id)' for h in HORIZONS)})
"""
_EPS = f""", x as (select *, coalesce(yes_ask - yes_bid >= {WIDE}, false) as wide from l1), y as (select *, cast(wide <> coalesce(lag(wide) over (partition by ticker order by ts, event_id), false) as int) as edge from x),
z as (select *, sum(edge) over (partition by ticker order by ts, event_id) as run, lead(ts) over (partition by ticker order by ts, event_id) as next_ts from y),
e as (select ticker, run, min(ts) as start_ts, max(ts) as last_ts, count(*) as n, last(next_ts order by event_id) as refill_ts, first(yes_bid order by event_id) as bid0, first(yes_ask order by event_id) as ask0, min(event_id) as first_id from z where wide group by ticker, run)
"""
_HAZ = _EPS + f""", a as (select ticker, date_diff('microsecond', start_ts, refill_ts) // {BIN_MINUTES * 60_000_000} as age, date_diff('microsecond', start_ts, last_ts) // {BIN_MINUTES * 60_000_000} as seen from e),
h as (select ticker, bin, age from a, unnest(range(0, least(coalesce(age, seen), {BINS - 1}) + 1)) u(bin))
"""
_MATCH = _EPS + f""", c as (select ticker, event_id as control, ts as cts, yes_bid as cbid, yes_ask as cask from l1 where yes_ask - yes_bid < {WIDE} and yes_ask > yes_bid),
pr as (select e.ticker, first_id as episode, control, date_diff('microsecond', cts, start_ts) as lag_us, abs((ask0 - bid0) - (cask - cbid)) as ds, bid0, ask0, cbid, cask from e join c on bid0 = cbid and cts < start_ts and cts >= start_ts - interval 24 hour
  and epoch_us(start_ts) // 86400000000 - epoch_us(cts) // 86400000000 in (0, 1)),
k1 as (select * from (select *, row_number() over (partition by episode order by ds, lag_us, control) as k from pr) where k = 1),
m as (select * exclude (k2) from (select *, row_number() over (partition by control order by ds, lag_us, episode) as k2 from k1) where k2 = 1)
"""

_SQL = {
    "state_transitions": oracle("with s as (select ticker, ts, event_id, " + _STATE + " as state from {l1}), t as (select ticker, state, lag(state) over (partition by ticker order by ts, event_id) as was from s) select was, state, count(*) as n from t where was is not null group by was, state"),
    "utc_rhythm": oracle("with h as (select extract(hour from ts) as hour, ticker, date_trunc('minute', ts) as minute from {l1}) select cast(hour as int) as hour, count(*) as updates, count(distinct concat(ticker, cast(minute as varchar(30)))) as active_market_minutes, round(cast(count(*) as double) / count(distinct concat(ticker, cast(minute as varchar(30)))), 6) as rate from h group by hour"),
    "trades_in_active_minutes": oracle("with a as (select distinct ticker, date_trunc('hour', ts) as slot from {l1}) select t.ticker, count(*) as trades, cast(sum(t.size) as bigint) as contracts from {trades} t where exists (select 1 from a where a.ticker = t.ticker and a.slot = date_trunc('hour', t.ts)) group by t.ticker"),
    "market_graph_status": oracle("with m as (select distinct ticker from {tape}) select m.ticker, d.event_ticker, d.series, case when d.ticker is null then 'MISSING_MARKET_DIM' when d.event_ticker is null then 'MISSING_EVENT_DIM' else 'CANONICAL_FAMILY_EVENT' end as mapping_status from m left join {dim_market} d on m.ticker = d.ticker"),
    "channel_coverage": oracle("""with a as (select cast(cast(ts as date) as varchar(10)) as day, ticker, count(*) as l1_rows from {l1} group by 1, 2), b as (select cast(cast(ts as date) as varchar(10)) as day, ticker, count(*) as trade_rows from {trades} group by 1, 2), c as (select cast(cast(ts as date) as varchar(10)) as day, ticker, count(*) as l2_rows from {frames} group by 1, 2)
select day, count(*) as market_days, cast(sum(coalesce(l1_rows, 0)) as bigint) as l1_rows, cast(sum(coalesce(trade_rows, 0)) as bigint) as trade_rows, cast(sum(coalesce(l2_rows, 0)) as bigint) as l2_rows, count(l1_rows) as l1_markets, count(trade_rows) as trade_markets, count(l2_rows) as l2_markets
from a full outer join b using (day, ticker) full outer join c using (day, ticker) group by day"""),
    "row_conservation": oracle("""with a as (select 'l1' as channel, cast(cast(ts as date) as varchar) as day, event_id as id from {l1} union all select 'trades', cast(cast(ts as date) as varchar), trade_id from {trades} union all select 'l2', cast(cast(ts as date) as varchar), arrival from {frames}),
m as (select 'l1' as channel, cast(cast(ts as date) as varchar) as day, event_id as id from events union all select 'trades', cast(cast(ts as date) as varchar), event_id from events where event_type = 'purchase' union all select 'l2', cast(cast(ts as date) as varchar), event_id from events where event_id % 97 <> 0),
x as (select coalesce(a.channel, m.channel) as channel, coalesce(a.day, m.day) as day, count(m.id) as expected, count(a.id) as actual, count(*) filter (a.id is null or m.id is null) as alone from a full outer join m on a.channel = m.channel and a.day = m.day and a.id = m.id group by 1, 2)
select channel, day, expected, actual, case when actual = 0 then 'MISSING' when expected = 0 then 'EXTRA' when actual < expected then 'LOST' when actual > expected then 'DOUBLED' when alone > 0 then 'REPLACED' else 'EXACT' end as state from x"""),
    "quality_state": oracle("""with pm as (select *, max(seq) over (partition by epoch, sid order by arrival rows between unbounded preceding and 1 preceding) as m from {frames}),
d as (select cast(cast(ts as date) as varchar(10)) as day, count(*) as n_rows, sum(case when seq > m + 1 then 1 else 0 end) as gap_events, sum(case when seq <= m then 1 else 0 end) as regressions from pm group by 1),
cal as (select distinct cast(cast(ts as date) as varchar(10)) as day from {l1})
select cal.day, coalesce(n_rows, 0) as n_rows, case when n_rows is null then 'NOT_APPLICABLE' when gap_events > 2 or regressions > 2 then 'REFUSED' else 'PASS' end as state,
  case when n_rows is null then 'ABSENT_NOT_CAPTURED' when gap_events > 2 or regressions > 2 then 'EXCLUDED_DATA_QUALITY' else 'INCLUDED_CLEAN_DATE' end as disposition,
  concat(case when gap_events > 2 then 'sequence_gaps;' else '' end, case when regressions > 2 then 'regressions;' else '' end) as blockers from cal left join d on cal.day = d.day"""),
    "candidate_funnel": oracle(ALIGNED + """select 'linked_event' as step, count(distinct (event_ticker, cast(ts as date))) as n, 'EXECUTED' as state from f where legs > 1 and quoted = legs
union all select 'payout_exhaustive', 0, 'NOT_ESTIMABLE' union all select 'fill_feasible', 0, 'NOT_ESTIMABLE'"""),
    "estimability": oracle("""with have as (select 'l1' as input, count(*) as n from {l1} union all select 'trades', count(*) from {trades} union all select 'l2', count(*) from {frames} union all select 'settlements', count(*) from {settles}),
need as (select * from (values ('markout', 'l1'), ('markout', 'trades'), ('dwell', 'l1'), ('refill', 'l2'), ('family_arb', 'payout_map'), ('calibration', 'settlements')) as v(method, input))
select method, min(coalesce(n, 0)) as eligible, case when min(coalesce(n, 0)) > 0 then 'EXECUTED' else 'NOT_ESTIMABLE' end as state, cast(sum(case when coalesce(n, 0) = 0 then 1 else 0 end) as bigint) as missing_inputs from need left join have on need.input = have.input group by method"""),
    "evidence_tier": oracle("""with g as (select sid, sum(case when seq > m + 1 then 1 else 0 end) as gaps, count(*) as n from (select *, max(seq) over (partition by epoch, sid order by arrival rows between unbounded preceding and 1 preceding) as m from {frames}) x group by sid)
select sid, case when gaps = 0 then 'A' when gaps * 100 <= n then 'B' else 'C' end as tier, case when gaps = 0 then '' else 'sequence_gaps' end as downgrade from g"""),
}

def one_sided_survival(spark, sf_dir):
    """How long a book stays in a one-sided state, by hours. A market's last row is censored at its state's longest hour (chosen)."""
    x = research.intervals(view(spark, sf_dir, "l1")).where("state in ('BID_ONLY', 'ASK_ONLY')").select("state", F.floor(F.col("dur_us") / 3_600_000_000).alias("h"))
    longest = F.max("h").over(Window.partitionBy("state"))
    x = x.select("state", F.coalesce("h", longest).alias("hours"), F.col("h").isNull().alias("open"))
    return research.kaplan_meier(x, "state", "hours", "open")


def atlas(spark, sf_dir):
    """Strata and rows of each record kind: states, transitions, episodes by market, refill hazards by age, and messages by market at
    which the depth of the three best levels is below its baseline."""
    b = view(spark, sf_dir, "l1")
    kinds = {
        "STATE": b.groupBy(research.state(F.col("yes_bid"), F.col("yes_ask")).alias("stratum")).agg(F.count(F.lit(1)).alias("n")),
        "TRANSITION": research.transitions(b).select(F.concat("was", F.lit(">"), "state").alias("stratum"), "n"),
        "EPISODE": _eps(spark, sf_dir).groupBy(F.col("ticker").alias("stratum")).agg(F.count(F.lit(1)).alias("n")),
        "REFILL_HAZARD": refill_hazard(spark, sf_dir).select(F.col("bin").cast("string").alias("stratum"), F.col("at_risk").alias("n")),
        "RETREAT_TOP3_BASELINE": book.depth_baseline(spark, sf_dir).where("under > 0").select(F.col("ticker").alias("stratum"), F.col("under").alias("n")),
    }
    each = [d.select(F.lit(k).alias("kind"), "n") for k, d in kinds.items()]
    return functools.reduce(DataFrame.unionByName, each).groupBy("kind").agg(F.count(F.lit(1)).alias("strata"), F.sum("n").alias("represented"))


def candidate_funnel(spark, sf_dir):
    """The tables bring no payout map, so the funnel ends where it is needed."""
    return features.funnel(view(spark, sf_dir, "l1"), view(spark, sf_dir, "dim_market"))


NEEDS = [("markout", "l1"), ("markout", "trades"), ("dwell", "l1"), ("refill", "l2"), ("family_arb", "payout_map"), ("calibration", "settlements")]


def estimability(spark, sf_dir):
    have = {"l1": "l1", "trades": "trades", "l2": "messages", "settlements": "settles"}
    counts = [view(spark, sf_dir, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("input"), "n") for k, v in have.items()]
    return research.estimable(functools.reduce(DataFrame.unionByName, counts), NEEDS)


_Q = {
    "state_transitions": over(research.transitions, "l1"),
    "utc_rhythm": over(research.utc_rhythm, "l1"),
    "trades_in_active_minutes": over(research.in_active_slots, "trades", "l1", slot="hour"),
    "market_graph_status": over(research.graph_status, "prints", "dim_market"),
    "channel_coverage": lambda spark, sf_dir: research.coverage({"l1": view(spark, sf_dir, "l1"), "trade": view(spark, sf_dir, "trades"), "l2": view(spark, sf_dir, "messages")}),
    "quality_state": over(research.quality_days, "frames", "l1", most=2),
    "evidence_tier": over(research.evidence, "frames"),
    "atlas": atlas, "one_sided_survival": one_sided_survival, "candidate_funnel": candidate_funnel, "estimability": estimability,
}

QUERIES = {f.__name__: f for f in (trade_book_asof, trade_markout_surface, markout_waterfall, one_sided_exposure, ttl_dwell, liquidity_episodes, refill_hazard, refill_survival, match_controls, match_coverage, match_balance, match_concentration)} | _Q | {"row_conservation": row_conservation}
ORACLE_SQL = {
    "trade_book_asof": with_views("trades l1", "select trade_id, t.ticker, b.yes_bid as bid, b.yes_ask as ask, date_diff('microsecond', b.ts, t.ts) as age_us from trades t asof left join l1 b on t.ticker = b.ticker and t.ts > b.ts"),
    "trade_markout_surface": with_views("trades l1 gaps", _SURF + f"select horizon, taker_yes, count(*) as n, cast(sum(d) as bigint) as sum_half_cents, round(sum(d) / count(*), 6) as mean_half_cents from ({' union all '.join(f'select {h} as horizon, taker_yes, (case when taker_yes then 1 else -1 end) * (m{h} - m0) as d from j' for h in HORIZONS)}) where d is not null group by 1, 2"),
    "markout_waterfall": with_views("trades l1 gaps", _SURF + f""", n as (select (select count(*) from p) as a, (select count(m0) from p) as b, (select count(m0) from j) as c, {', '.join(f'(select count(*) from j where m0 is not null and m{h} is not null) as h{h}' for h in HORIZONS)})
select 'all_trades' as step, 'none' as base_step, a as n, 0 as excluded from n union all select 'past_book', 'all_trades', b, a - b from n union all select 'gap_clean', 'past_book', c, b - c from n {' '.join(f"union all select 'future_{h}h', 'gap_clean', h{h}, c - h{h} from n" for h in HORIZONS)}"""),
    "one_sided_exposure": with_views("l1", f", i as (select {_STATE} as state, date_diff('microsecond', ts, lead(ts) over (partition by ticker order by ts, event_id)) as d from l1) select state, count(*) as n, cast(sum(d) as bigint) as exposure_us, count(*) - count(d) as censored, round(quantile_cont(d, 0.5), 3) as p50_us, round(quantile_cont(d, 0.95), 3) as p95_us from i group by state"),
    "ttl_dwell": with_views("l1", f""", i as (select ts, {_STATE} as state, date_diff('microsecond', ts, lead(ts) over (partition by ticker order by ts, event_id)) as d from l1), t as (select *, unnest({list(TTLS)}) as ttl_min from i where state <> 'NONE')
select cast(cast(ts as date) as varchar) as day, cast(ttl_min as int) as ttl_min, case when d is null then '{research.LAST}' when d > ttl_min::bigint * 60000000 then '{research.STALE}' else '{research.OBSERVED}' end as reason, count(*) as n, cast(sum(case when d is null then 0 else least(d, ttl_min::bigint * 60000000) end) as bigint) as dwell_us from t group by 1, 2, 3"""),
    "atlas": with_views("l1", _HAZ + f""", s0 as (select ticker, ts, event_id, {_STATE} as state from l1), t0 as (select state, lag(state) over (partition by ticker order by ts, event_id) as was from s0),
u as (select 'STATE' as kind, state as stratum, count(*) as n from s0 group by state union all select 'TRANSITION', concat(was, '>', state), count(*) from t0 where was is not null group by 1, 2
  union all select 'EPISODE', ticker, count(*) from e group by ticker union all select 'REFILL_HAZARD', cast(bin as varchar), count(*) from h group by bin
  union all select 'RETREAT_TOP3_BASELINE', ticker, under from ({book.ORACLE_SQL["depth_baseline"]}) where under > 0)
select kind, count(*) as strata, cast(sum(n) as bigint) as represented from u group by kind"""),
    "one_sided_survival": with_views("l1", f""", i as (select {_STATE} as state, date_diff('microsecond', ts, lead(ts) over (partition by ticker order by ts, event_id)) // 3600000000 as h from l1), o as (select state, coalesce(h, max(h) over (partition by state)) as hours, h is null as open from i where state in ('BID_ONLY', 'ASK_ONLY')),
r as (select a.state, a.hours, count(*) as at_risk from (select distinct state, hours from o) a join o b on b.state = a.state and b.hours >= a.hours group by 1, 2), e as (select state, hours, count(*) filter (not open) as ended from o group by 1, 2), x as (select * from r join e using (state, hours))
select state, hours, at_risk, ended, round(product(1 - ended / at_risk) over (partition by state order by hours), 6) as lasting from x"""),
    "liquidity_episodes": with_views("l1", _EPS + "select ticker, first_id, n, date_diff('microsecond', start_ts, last_ts) as length_us, date_diff('microsecond', start_ts, refill_ts) as refill_us from e"),
    "refill_hazard": with_views("l1", _HAZ + "select bin, count(*) as at_risk, count(*) filter (age = bin) as events, round(count(*) filter (age = bin) / count(*), 6) as hazard from h group by bin"),
    "refill_survival": with_views("l1", _HAZ + ", g as (select ticker, bin, count(*) as at_risk, 1 - count(*) filter (age = bin) / count(*) as s from h group by 1, 2) select ticker, bin, at_risk, round(1 - product(s) over (partition by ticker order by bin), 6) as refilled from g"),
    "match_controls": with_views("l1", _MATCH + "select ticker, episode, control, lag_us from m"),
    "match_coverage": with_views("l1", _MATCH + "select e.ticker, count(*) as episodes, count(control) as matched, count(*) - count(control) as unmatched, round(count(control) / count(*), 6) as rate from e left join m on first_id = episode group by 1"),
    "match_balance": with_views("l1", _MATCH + "select count(*) as n, round(avg(abs(t - c)), 6) as mean_abs, round(quantile_cont(abs(t - c), 0.95), 6) as p95_abs, round((avg(t) - avg(c)) / sqrt((var_samp(t) + var_samp(c)) / 2), 6) as smd, round(quantile_cont(lag_us, 0.5), 3) as median_lag_us, round(quantile_cont(lag_us, 0.95), 3) as p95_lag_us from (select lag_us, ask0 - bid0 as t, cask - cbid as c from m)"),
    "match_concentration": with_views("l1", _MATCH + "select count(*) as markets, round(sum(n * n) / (sum(n) * sum(n)), 6) as hhi, round(max(n) / sum(n), 6) as max_share from (select ticker, count(*) as n from m group by 1)"),
} | _SQL
