"""Signal features as functions of quote, trade and outcome frames. Thresholds are parameters.

quotes: ticker, event_id, ts, yes_bid, yes_ask (null: that side is empty). trades: trade_id, ticker, ts, price_cents, size, taker_yes.
Order within a market is by time, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.slices import looked, over, sliced

QUOTE_ORDER = ("ts", "event_id")
TRADE_ORDER = ("ts", "trade_id")


def _in_order(*by: str) -> Window:
    return Window.partitionBy("ticker").orderBy(*by)


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def two_sided(quotes: DataFrame) -> DataFrame:
    return quotes.where(F.col("yes_bid").isNotNull() & F.col("yes_ask").isNotNull())


def stepped(quotes: DataFrame, slices: int | None = None) -> DataFrame:
    """Two-sided quotes with twice the mid, and the quote before and the mid after: bid0, ask0, mid0, ts0, mid1."""
    q = two_sided(quotes).select("event_id", "ts", "ticker", F.col("yes_bid").alias("bid"), F.col("yes_ask").alias("ask"), (F.col("yes_bid") + F.col("yes_ask")).alias("mid2"))
    q = over(q, ("ticker",), QUOTE_ORDER, slices, before={"was": F.struct("bid", "ask", "mid2", "ts")}, after={"mid1": F.col("mid2")})
    return q.select(*(c for c in q.columns if c != "was"), F.col("was.bid").alias("bid0"), F.col("was.ask").alias("ask0"), F.col("was.mid2").alias("mid0"), F.col("was.ts").alias("ts0"))


def move() -> Column:
    return F.col("mid2") - F.col("mid0")


def spread_net(quotes: DataFrame, buffer: int) -> DataFrame:
    """Spread of each market, and how often it is over the buffer."""
    spread = F.col("yes_ask") - F.col("yes_bid")
    return two_sided(quotes).groupBy("ticker").agg(_n(), F.sum(spread).alias("spread_sum"), F.count_if(spread > buffer).alias("above_buffer"))


def flow_toxicity(trades: DataFrame, length: int) -> DataFrame:
    """Mean share of one-sided flow in the last `length` trades."""
    w = _in_order(*TRADE_ORDER).rowsBetween(1 - length, 0)
    signed = F.sum(F.when(F.col("taker_yes"), F.col("size")).otherwise(-F.col("size"))).over(w)
    t = trades.select("ticker", (F.abs(signed) / F.sum("size").over(w)).alias("share"))
    return t.groupBy("ticker").agg(_n(), F.round(F.avg("share"), 6).alias("toxicity"))


def regime_changes(quotes: DataFrame, tight: int, normal: int) -> DataFrame:
    """How often one spread regime follows another."""
    s = F.col("yes_ask") - F.col("yes_bid")
    regime = F.when(s.isNull(), "one_sided").when(s <= tight, "tight").when(s <= normal, "normal").otherwise("wide")
    r = quotes.withColumn("regime", regime).withColumn("was", F.lag("regime").over(_in_order(*QUOTE_ORDER)))
    return r.where(F.col("was") != F.col("regime")).groupBy("was", "regime").agg(_n())


def quote_lifetimes(quotes: DataFrame, burst: int) -> DataFrame:
    """Lifetimes in messages: how many, the shortest, and how many within a burst."""
    life = F.lead("event_id").over(_in_order(*QUOTE_ORDER)) - F.col("event_id")
    return quotes.withColumn("life", life).groupBy("ticker").agg(F.count("life").alias("n"), F.min("life").alias("shortest"), F.count_if(F.col("life") <= burst).alias("bursts"))


def price_grid(trades: DataFrame) -> DataFrame:
    p = F.col("price_cents")
    return trades.groupBy((p % 5 == 0).alias("round_number"), (p % 10).alias("cell")).agg(_n(), F.sum("size").alias("contracts"))


def seasonality(quotes: DataFrame) -> DataFrame:
    spread = (F.col("yes_ask") - F.col("yes_bid")).cast("double")
    return quotes.groupBy(F.hour("ts").alias("hour")).agg(_n(), F.round(F.avg(spread), 6).alias("spread"), F.countDistinct("ticker").alias("markets"))


def one_sided_gate(quotes: DataFrame, hours: int) -> DataFrame:
    """One-sided quotes of each market, and those that stood for so many hours or more."""
    one = F.col("yes_bid").isNull() | F.col("yes_ask").isNull()
    until = F.lead("ts").over(_in_order(*QUOTE_ORDER))
    return quotes.select("ticker", one.alias("one"), (until - F.col("ts") >= F.expr(f"interval {hours} hour")).alias("held")).groupBy("ticker").agg(F.count_if("one").alias("one_sided"), F.count_if(F.col("one") & F.col("held")).alias("held_2h"))


def displacement(sized: DataFrame) -> DataFrame:
    """Mean distance of the size-weighted price from the mid. sized: ticker, bid, ask, bid_size, ask_size."""
    b, a, bq, aq = (F.col(c).cast("double") for c in ("bid", "ask", "bid_size", "ask_size"))
    return sized.groupBy("ticker").agg(_n(), F.round(F.avg((b * aq + a * bq) / (aq + bq) - (b + a) / 2), 6).alias("displacement"))


def jumps_without_trade(quotes: DataFrame, trades: DataFrame, least: int) -> DataFrame:
    """Jumps of twice the mid by `least` or more, and those with no trade since the quote before.

    One union and one sort by market: the time of the last trade at or before a quote tells whether one lies in between."""
    g = stepped(quotes).where(F.abs(move()) >= least).select("ticker", "ts", F.lit(1).alias("rank"), "ts0")
    both = g.unionByName(trades.select("ticker", "ts", F.lit(0).alias("rank")), allowMissingColumns=True)
    past = Window.partitionBy("ticker").orderBy("ts", "rank").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("rank") == 0, F.col("ts"))).over(past)
    j = both.withColumn("last", last).where("rank = 1")
    return j.groupBy("ticker").agg(F.count(F.lit(1)).alias("jumps"), F.count_if(F.col("last").isNull() | (F.col("last") <= F.col("ts0"))).alias("without_trade"))


def momentum(quotes: DataFrame) -> DataFrame:
    both = F.signum(move()) * F.signum(F.col("mid1") - F.col("mid2"))
    g = stepped(quotes).where("mid0 is not null and mid1 is not null")
    return g.groupBy("ticker").agg(_n(), F.count_if(both > 0).alias("continued"), F.count_if(both < 0).alias("reverted"))


def post_jump(quotes: DataFrame, least: int) -> DataFrame:
    g = stepped(quotes).where((F.abs(move()) >= least) & F.col("mid1").isNotNull())
    return g.groupBy((move() > 0).alias("up")).agg(F.count(F.lit(1)).alias("jumps"), F.sum(F.col("mid1") - F.col("mid2")).alias("forward_half_cents"))


def flow_imbalance(quotes: DataFrame) -> DataFrame:
    """Sum of the signs of bid moves and of ask moves: both up is +2."""
    step = F.signum(F.col("bid") - F.col("bid0")) + F.signum(F.col("ask") - F.col("ask0"))
    return stepped(quotes).where("bid0 is not null").groupBy("ticker").agg(F.sum(step).cast("bigint").alias("ofi"), _n())


def listing_drift(trades: DataFrame, most_days: int) -> DataFrame:
    """Mean price by days since a market's first trade."""
    age = F.datediff(F.col("ts").cast("date"), F.min("ts").over(Window.partitionBy("ticker")).cast("date"))
    return trades.withColumn("age_day", F.least(F.lit(most_days), age)).groupBy("age_day").agg(_n(), F.round(F.avg("price_cents"), 6).alias("mean_price"))


def realized_vol(quotes: DataFrame) -> DataFrame:
    g = stepped(quotes).where("mid0 is not null")
    return g.groupBy("ticker", (F.hour("ts") < 12).alias("morning")).agg(_n(), F.sum(move() * move()).alias("sum_sq"))


def jump_hazard(quotes: DataFrame, least: int, length: int) -> DataFrame:
    """Share of jumps by how many of the `length` quotes before were jumps."""
    w = _in_order(*QUOTE_ORDER).rowsBetween(-length, -1)
    g = stepped(quotes).where("mid0 is not null").withColumn("jump", (F.abs(move()) >= least).cast("int"))
    g = g.withColumn("recent", F.sum("jump").over(w)).where("recent is not null")
    return g.groupBy("recent").agg(F.count(F.lit(1)).alias("at_risk"), F.sum("jump").alias("jumps"), F.round(F.avg("jump"), 6).alias("hazard"))


def settled(prints: DataFrame, settles: DataFrame) -> DataFrame:
    return prints.join(settles, "ticker")


def high_ask(prints: DataFrame, low: int, high: int) -> DataFrame:
    return prints.where(F.col("price_cents").between(low, high)).groupBy("ticker").agg(_n(), F.count_if("yes_wins").alias("wins"))


def aligned(quotes: DataFrame, dim: DataFrame, slices: int | None = None) -> DataFrame:
    """All legs of an event at each update of one of them: event_ticker, event_id, ts, quoted (legs with an ask), legs, sum_ask.

    The last asks of all legs change by one leg's step at a time, so their sum at each update is the running sum of steps: each
    leg's ask less its ask before, an empty side counting as nothing. No map of legs is held, and no leg is joined with another."""
    d = dim.where("event_ticker is not null").select("ticker", "event_ticker").distinct()
    legs = d.groupBy("event_ticker").agg(F.count(F.lit(1)).alias("legs"))
    q = quotes.select("ticker", "event_id", "ts", F.struct("yes_ask").alias("now"))
    q = over(q, ("ticker",), QUOTE_ORDER, slices, before={"was": F.col("now")}).join(d, "ticker")
    ask, was = F.col("now.yes_ask"), F.col("was.yes_ask")
    steps = q.select("event_ticker", "event_id", "ts", (F.coalesce(ask, F.lit(0)) - F.coalesce(was, F.lit(0))).alias("d_ask"), (ask.isNotNull().cast("int") - F.coalesce(was.isNotNull(), F.lit(False)).cast("int")).alias("d_legs"))
    sums = over(steps, ("event_ticker",), QUOTE_ORDER, slices, sums={"sum_ask": F.col("d_ask"), "quoted": F.col("d_legs")})
    return sums.join(legs, "event_ticker").select("event_ticker", "event_id", "ts", "quoted", "legs", "sum_ask")


def overround(quotes: DataFrame, dim: DataFrame) -> DataFrame:
    """By event and day, over the updates at which all its legs have an ask: how many, and how far the sum of the asks is from 100.

    Whether the legs exhaust the payout is not known without a payout map, so the state is NOT_ESTIMABLE: these are sums, no residuals."""
    full = aligned(quotes, dim).where("legs > 1 and quoted = legs").withColumn("over", F.col("sum_ask") - 100)
    return full.groupBy("event_ticker", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("legs").alias("legs"), F.min("over").alias("least"), F.max("over").alias("most"), F.sum("over").alias("total"), F.lit("NOT_ESTIMABLE").alias("state"),
    )


def funnel(quotes: DataFrame, dim: DataFrame, payouts: DataFrame | None = None, trades: DataFrame | None = None) -> DataFrame:
    """Candidates of a family trade: event-days with all legs quoted at one time, those whose legs exhaust the payout (payouts: event_ticker), and
    those of which every leg traded that day. A step without its input has no candidates and is NOT_ESTIMABLE."""
    linked = overround(quotes, dim).select("event_ticker", "day", "legs")
    steps, known = [("linked_event", linked)], payouts is not None
    paid = linked.join(payouts.select("event_ticker").distinct(), "event_ticker", "left_semi") if known else linked.limit(0)
    steps.append(("payout_exhaustive", paid))
    traded = paid.limit(0)
    if known and trades is not None:
        t = trades.join(dim.select("ticker", "event_ticker"), "ticker").groupBy("event_ticker", F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("ticker").alias("traded"))
        traded = paid.join(t, ["event_ticker", "day"]).where("traded = legs")
    steps.append(("fill_feasible", traded))
    out = None
    for i, (name, rows) in enumerate(steps):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n", F.lit("EXECUTED" if i == 0 or (known and (i == 1 or trades is not None)) else "NOT_ESTIMABLE").alias("state"))
        out = one if out is None else out.unionByName(one)
    return out


def monotonicity(trades: DataFrame, dim: DataFrame, strike: str) -> DataFrame:
    """strike: SQL of a leg's strike. Legs of an event whose mean price is above that of the next lower strike."""
    p = trades.groupBy("ticker").agg(F.avg("price_cents").alias("p")).join(dim.where("event_ticker is not null").select("ticker", "event_ticker"), "ticker")
    below = F.lag("p").over(Window.partitionBy("event_ticker").orderBy(F.expr(strike)))
    return p.withColumn("below", below).groupBy("event_ticker").agg(F.count(F.lit(1)).alias("legs"), F.count_if(F.col("p") > F.col("below")).alias("breaches"))


def calibration(prints: DataFrame, width: int) -> DataFrame:
    won, p = F.col("yes_wins").cast("double"), F.col("price_cents") / 100
    return prints.groupBy(F.floor(F.col("price_cents") / width).cast("int").alias("band")).agg(_n(), F.round(F.avg(won), 6).alias("win_rate"), F.round(F.avg((p - won) * (p - won)), 6).alias("brier"))


def rfq_census(requests: DataFrame, small: int, medium: int) -> DataFrame:
    n = F.col("rfqs")
    r = requests.where("method = 'POST'").groupBy("account").agg(F.count(F.lit(1)).alias("rfqs"), F.min("req_id").alias("first_id"))
    return r.withColumn("bucket", F.when(n < small, "small").when(n < medium, "medium").otherwise("large"))


def lifetimes(requests: DataFrame, slices: int | None = None) -> DataFrame:
    """When each creation ends, first in, first out: account, req_id, ts, end_ts (null while open). requests: account, req_id, ts, d (1 or -1).

    A deletion is void if it takes the account's balance below all before and below 0: nothing was open. The k-th of the others
    ends the k-th creation, as what is open is never negative, so running counts pair them."""
    by = ("ts", "req_id")
    x = looked(sliced(requests, by, slices), ("account",), by, sums={"balance": F.col("d"), "born": F.when(F.col("d") > 0, 1)})
    x = looked(x, ("account",), by, lows={"low": F.col("balance")})
    real = (F.col("d") < 0) & (F.col("balance") >= F.least(F.lit(0), F.coalesce("low", F.lit(0))))
    x = looked(x.withColumn("ends", real.cast("int")), ("account",), by, sums={"ended": F.col("ends")})
    ends = x.where("ends = 1").select("account", F.col("ended").alias("born"), F.col("ts").alias("end_ts"))
    return x.where("d > 0").select("account", "req_id", "ts", "born").join(ends, ["account", "born"], "left").drop("born")


def readiness(quotes: DataFrame, least_days: int, share: float) -> DataFrame:
    both = F.count_if(F.col("yes_bid").isNotNull() & F.col("yes_ask").isNotNull())
    a = quotes.groupBy("ticker").agg(_n(), F.countDistinct(F.to_date("ts")).alias("days"), both.alias("two_sided"))
    return a.select("ticker", ((F.col("days") >= least_days) & (F.col("two_sided") >= share * F.col("n"))).alias("ready"), "days", "two_sided")


def composite_rank(trades: DataFrame) -> DataFrame:
    """Mean of the percent ranks by trades and by contracts: one row a market, ranked over all markets."""
    a = trades.groupBy("ticker").agg(_n(), F.sum("size").alias("v"))
    rank = lambda c: F.percent_rank().over(Window.orderBy(c))
    return a.select("ticker", F.round((rank("n") + rank("v")) / 2, 6).alias("score"))


def thin_gate(quotes: DataFrame, days: int, rows: int, spread: float) -> DataFrame:
    age = F.datediff(F.max("ts").cast("date"), F.min("ts").cast("date"))
    a = quotes.groupBy("ticker").agg(age.alias("age"), _n(), F.avg(F.col("yes_ask") - F.col("yes_bid")).alias("spread"))
    return a.select("ticker", ((F.col("age") >= days) & (F.col("n") < rows) & (F.col("spread") > spread)).alias("thin"))


def lifecycle_census(requests: DataFrame) -> DataFrame:
    """How many accounts ever read, cancelled and placed or failed (a, b, c)."""
    has = lambda c: F.max(c.cast("int"))
    m = F.col("method")
    p = requests.groupBy("account").agg(has(m == "GET").alias("a"), has(m == "DELETE").alias("b"), has(~m.isin("GET", "DELETE")).alias("c"))
    return p.groupBy("a", "b", "c").agg(_n())


def intent_overlap(intents: DataFrame, default_days: int) -> DataFrame:
    """Intents placed while an earlier one of the same market still rests."""
    until = F.coalesce("cancel_ts", F.col("place_ts") + F.expr(f"interval {default_days} day"))
    past = Window.partitionBy("ticker").orderBy("place_ts", "cid").rowsBetween(Window.unboundedPreceding, -1)
    q = intents.withColumn("busy", F.max(until).over(past))
    return q.groupBy("ticker").agg(F.count(F.lit(1)).alias("intents"), F.count_if(F.col("place_ts") < F.col("busy")).alias("overlapping"))


def changes_only(quotes: DataFrame) -> DataFrame:
    """Quotes that differ from the one before in their market, numbered anew."""
    w = _in_order(*QUOTE_ORDER)
    pair = F.struct("yes_bid", "yes_ask")
    q = quotes.withColumn("was", F.lag(pair).over(w)).where(~pair.eqNullSafe(F.col("was")))
    return q.select("event_id", "ticker", F.row_number().over(w).alias("seq"))


def deduplicated(trades: DataFrame) -> DataFrame:
    """Rows seen and distinct trades kept, by market."""
    each = trades.groupBy("trade_id", "ticker").agg(F.count(F.lit(1)).alias("seen"))
    return each.groupBy("ticker").agg(F.sum("seen").alias("seen"), F.count(F.lit(1)).alias("kept"))
