"""Exposure and lifecycle of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.orders import risk_cents
from tapewright.operators.slices import over

# The seven states of an order, and what may follow what.
STATES = ("Free", "PendingNew", "Open", "PendingCancel", "Filled", "Canceled", "Expired")
LEGAL = (
    ("Free", "PendingNew"), ("PendingNew", "Open"), ("Open", "PendingCancel"), ("Open", "Filled"), ("Open", "Expired"),
    ("PendingCancel", "Canceled"), ("PendingCancel", "Filled"),
)
TERMINAL = ("Filled", "Canceled", "Expired")


def lifecycle(quotes: DataFrame, fills: DataFrame) -> DataFrame:
    """Open, fill and cancel events: cid, ticker, ts, step, tape_id, event, d (contracts), d_risk (cents)."""
    done = fills.groupBy("cid").agg(F.sum("qty").alias("done"))
    left = F.col("count") - F.coalesce("done", F.lit(0))
    base = ("cid", "ticker", "price_cents", "buy_yes")
    opened = quotes.select(*base, F.col("place_ts").alias("ts"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("tape_id"), F.lit("open").alias("event"), F.col("count").cast("bigint").alias("d"))
    filled = fills.select(*base, "ts", F.lit(1).alias("step"), "tape_id", F.lit("fill").alias("event"), (-F.col("qty")).cast("bigint").alias("d"))
    ended = quotes.join(done, "cid", "left").where(F.col("cancel_ts").isNotNull() & (left > 0)).select(*base, F.col("cancel_ts").alias("ts"), F.lit(2).alias("step"), F.lit(0).cast("bigint").alias("tape_id"), F.lit("cancel").alias("event"), (-left).cast("bigint").alias("d"))
    return opened.unionByName(filled).unionByName(ended).withColumn("d_risk", risk_cents(F.col("d"), F.col("price_cents"), F.col("buy_yes")))


def running(events: DataFrame, slices: int | None = None) -> DataFrame:
    """at_risk_cents and open_contracts of the market after each event."""
    return over(events, ("ticker",), ("ts", "step", "tape_id", "cid"), slices, sums={"at_risk_cents": F.col("d_risk"), "open_contracts": F.col("d")})


def daily_total(events: DataFrame) -> DataFrame:
    """Exposure over all markets at the end of each day: summed by day first, so the running total is over days only."""
    days = events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum("d_risk").alias("r"), F.sum("d").alias("o"))
    by = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(F.col("day").cast("string").alias("day"), F.sum("r").over(by).alias("at_risk_cents"), F.sum("o").over(by).alias("open_contracts"))


def caps(events: DataFrame, market_cap: int, total_cap: int) -> DataFrame:
    """By day: markets that were over the market cap after some event, exposure at the end of the day, and whether it is over the cap."""
    day = F.col("ts").cast("date").cast("string").alias("day")
    over = running(events).groupBy(day, "ticker").agg(F.max("at_risk_cents").alias("most")).groupBy("day").agg(F.count_if(F.col("most") > market_cap).alias("markets_over"))
    return daily_total(events).join(over, "day").select("day", "at_risk_cents", "markets_over", (F.col("at_risk_cents") > total_cap).alias("total_over"))


def states(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """The states that each order goes through: cid, at, rank, state. An order's own row holds all that decides them.

    orders: cid, count, place_ts, cancel_ts, latency_days, ineligible, settle_ts. PendingNew lasts from placement until the latency has passed, and
    so does PendingCancel from the request, which waits until the order is open; an order that its track cannot follow
    expires when it opens; a settlement expires an open order, cancels one whose cancellation is pending, and leaves one that
    is not open yet; a fill counts when it is the last. Of events at one time clocks come first, then settlement, then
    prints (chosen). Nothing follows a terminal state."""
    by = F.struct("ts", "tape_id")
    done = fills.groupBy("cid").agg(F.sum("qty").alias("done"), F.max_by("ts", by).alias("full_ts"))
    o = orders.join(done, "cid", "left")
    wait = F.make_interval(days=F.col("latency_days"))
    active, request = F.col("place_ts") + wait, F.greatest(F.col("cancel_ts"), F.col("place_ts") + wait)
    at = lambda when, rank, state, ok=F.lit(True): F.when(when.isNotNull() & ok, F.struct(when.alias("at"), F.lit(rank).alias("rank"), state.alias("state")))
    open_ = ~F.col("ineligible")
    cancels = F.col("cancel_ts").isNotNull()
    settled = F.when(cancels & (request <= F.col("settle_ts")), "Canceled").otherwise("Expired")
    events = F.array(
        at(F.col("place_ts"), 0, F.lit("PendingNew")), at(active, 1, F.lit("Open")), at(active, 2, F.lit("Expired"), ~open_),
        at(request, 2, F.lit("PendingCancel"), cancels), at(F.col("cancel_ts") + wait, 3, F.lit("Canceled"), cancels),
        at(F.col("settle_ts"), 4, settled, active <= F.col("settle_ts")), at(F.col("full_ts"), 5, F.lit("Filled"), F.col("done") >= F.col("count")),
    )
    o = o.select("cid", F.array_sort(F.filter(events, lambda e: e.isNotNull())).alias("events"))
    end = F.array_min(F.filter("events", lambda e: e["state"].isin(*TERMINAL)))
    o = o.withColumn("end", end).withColumn("e", F.explode("events"))
    return o.where(F.col("end").isNull() | (F.struct("e.at", "e.rank") <= F.struct("end.at", "end.rank"))).select("cid", "e.*")


def audit(log: DataFrame) -> DataFrame:
    """How often a state follows a state in a log of states (cid, at, rank, state), and whether it may."""
    by = Window.partitionBy("cid").orderBy("at", "rank")
    was = F.coalesce(F.lag("state").over(by), F.lit("Free"))
    pairs = log.select(was.alias("was"), "state").groupBy("was", "state").agg(F.count(F.lit(1)).alias("n"))
    legal = F.array(*(F.lit(f"{a}>{b}") for a, b in LEGAL))
    return pairs.withColumn("illegal", ~F.array_contains(legal, F.concat_ws(">", "was", "state")))
