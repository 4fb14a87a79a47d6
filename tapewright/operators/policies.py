"""Lead and lag of linked markets, size ranks against the past, and the capital and PnL of a policy. Formulas are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.orders import fee_cents
from tapewright.operators.research import micros


def lead_lag(l1: DataFrame, links: DataFrame, hours: int) -> DataFrame:
    """Moves of each follower's mid against the leader's last strictly earlier move, by pair (chosen): how many have one of at most
    `hours` (aged), in how many of those the follower had stood still since before it (stale), and whether it went the same way.

    links: event_ticker, leader, follower: a small dimension."""
    by = Window.partitionBy("ticker").orderBy("ts", "event_id")
    m = l1.where("yes_bid is not null and yes_ask is not null").withColumn("mid2", F.col("yes_bid") + F.col("yes_ask"))
    m = m.withColumn("d", F.col("mid2") - F.lag("mid2").over(by)).withColumn("since", F.first("ts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.where("d <> 0").withColumn("since", F.coalesce(F.lag("ts").over(by), "since"))
    pair, none = ["event_ticker", "leader", "follower"], "struct<ts: timestamp_ntz, since: timestamp_ntz, d: int>"
    seen = F.struct("ts", "since", F.col("d").cast("int").alias("d"))
    lead = m.join(links, F.col("ticker") == F.col("leader")).select(*pair, F.col("ts").alias("at"), F.lit(1).alias("rank"), F.col("event_id").alias("id"), seen.alias("lead"), F.lit(None).cast(none).alias("move"))
    move = m.join(links, F.col("ticker") == F.col("follower")).select(*pair, F.col("ts").alias("at"), F.lit(0).alias("rank"), F.col("event_id").alias("id"), F.lit(None).cast(none).alias("lead"), seen.alias("move"))
    past = Window.partitionBy(*pair).orderBy("at", "rank", "id").rowsBetween(Window.unboundedPreceding, -1)
    x = lead.unionByName(move).withColumn("lead", F.last("lead", ignorenulls=True).over(past)).where("move is not null").withColumn("age", micros("lead.ts", "move.ts"))
    aged = F.coalesce(F.col("age") <= hours * 3_600_000_000, F.lit(False))
    stale = aged & (F.col("move.since") < F.col("lead.ts"))
    same = F.signum(F.col("lead.d")) * F.signum(F.col("move.d"))
    return x.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("moves"), F.count_if(aged).alias("aged"), F.count_if(stale).alias("stale"), F.count_if(stale & (same > 0)).alias("same_way"), F.count_if(stale & (same < 0)).alias("other_way"),
        F.round(F.avg(F.when(stale, F.col("age"))) / 1_000_000, 3).alias("mean_lag_s"),
    )


def past_rank(trades: DataFrame, sizes: range) -> DataFrame:
    """trades with past_rank, the share of the market's earlier trades that were smaller; null without earlier ones. `sizes` holds all
    sizes there can be, and one outside fails: running counts by size need no look at the later trades."""
    by = Window.partitionBy("ticker").orderBy("ts", "trade_id").rowsBetween(Window.unboundedPreceding, -1)
    below = F.array(*(F.coalesce(F.count_if(F.col("size") < s).over(by), F.lit(0)) for s in sizes))
    at = F.when(F.col("size").between(sizes[0], sizes[-1]), F.col("size") - sizes[0] + 1).otherwise(F.raise_error(F.lit("a size outside the bins")).cast("int"))
    earlier = F.count(F.lit(1)).over(by)
    return trades.withColumn("past_rank", F.when(earlier > 0, F.element_at(below, at) / earlier))


def running_capital(opens: DataFrame, settled: DataFrame, *key: str) -> DataFrame:
    """Capital in use after each time and step: openings (step 0) add theirs, a market's settlement (step 1) frees all it holds.

    opens: key, ticker, ts, cap. settled: ticker, ts. Openings of one time only add, so one row for each time keeps the peak."""
    freed = opens.groupBy(*dict.fromkeys((*key, "ticker"))).agg(F.sum("cap").alias("cap")).join(settled, "ticker").select(*key, "ts", F.lit(1).alias("step"), (-F.col("cap")).alias("cap"))
    x = opens.select(*key, "ts", F.lit(0).alias("step"), "cap").unionByName(freed).groupBy(*key, "ts", "step").agg(F.sum("cap").alias("cap"))
    return x.withColumn("capital", F.sum("cap").over(Window.partitionBy(*key).orderBy("ts", "step").rowsBetween(Window.unboundedPreceding, 0)))


def _sums(on: Column, name: str) -> list[Column]:
    """Gross and fee of the prints that are bought; a market's unsettled result or unknown rate leaves null, unless nothing is bought."""
    value = F.col("size") * (F.when(F.col("yes_wins").isNull(), F.lit(None).cast("int")).when(F.col("yes_wins"), 100).otherwise(0) - F.col("price_cents"))
    fee = fee_cents(F.col("taker_rate_e4"), F.col("size"), F.col("price_cents"))
    gap = F.count_if(on & (value - fee).isNull()) > 0
    return [F.when(~gap, F.coalesce(F.sum(F.when(on, value - fee)), F.lit(0))).alias(name)]


def policy_days(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """Net PnL of buying the `taken` prints against buying all (chosen baseline: the same trade unfiltered), by root event and UTC day.

    A market is open on each day from its first to its last print, when it settles (chosen); open days without a fill count zero.
    The six denominators come along. An unknown fee or result leaves the day's PnL null. A market without an event stays alone.
    prints: ticker, day, price_cents, size, taken, yes_wins, taker_rate_e4. roots: ticker, event_ticker: a small dimension."""
    on = F.col("taken")
    done = prints.groupBy("ticker", "day").agg(
        F.count(F.lit(1)).alias("opportunities"), F.count_if(on).alias("triggers"), F.coalesce(F.sum(F.when(on, F.col("size"))), F.lit(0)).alias("contracts"),
        F.coalesce(F.sum(F.when(on, F.col("size").cast("bigint") * F.col("price_cents"))), F.lit(0)).alias("cap"), *_sums(on, "net"), *_sums(F.lit(True), "base"), F.lit(True).alias("seen"),
    )
    span = prints.groupBy("ticker").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    zero = {c: F.when(F.col("seen"), F.col(c)).otherwise(0).alias(c) for c in ("opportunities", "triggers", "contracts", "cap", "net", "base")}
    days = span.select("ticker", F.explode(F.sequence("first", "last")).alias("day")).join(done, ["ticker", "day"], "left").select("ticker", "day", *zero.values())
    days = days.join(roots, "ticker", "left").withColumn("market", F.when(F.col("event_ticker").isNull(), F.col("ticker")))
    key = [F.coalesce("event_ticker", F.lit("")).alias("event_ticker"), F.coalesce("market", F.lit("")).alias("market")]
    days = days.select(*key, "ticker", F.col("day").alias("ts"), *zero)
    peak = running_capital(days, span.select("ticker", F.col("last").alias("ts")), "event_ticker", "market").where("step = 0").select("event_ticker", "market", "ts", F.col("capital").alias("peak_capital"))
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    out = days.groupBy("event_ticker", "market", "ts").agg(
        whole("net").alias("net_cents"), whole("base").alias("baseline_cents"), F.count(F.lit(1)).alias("market_days"), F.sum("opportunities").alias("opportunities"), F.sum("triggers").alias("triggers"),
        F.sum("triggers").alias("fills"), F.sum("contracts").alias("contracts"),
    )
    out = out.join(peak, ["event_ticker", "market", "ts"])
    return out.select(F.nullif("event_ticker", F.lit("")).alias("event_ticker"), F.nullif("market", F.lit("")).alias("market"), F.col("ts").cast("string").alias("day"), "net_cents", "baseline_cents", (F.col("net_cents") - F.col("baseline_cents")).alias("delta_cents"), "opportunities", "triggers", "fills", "contracts", "market_days", "peak_capital")


def capital_return(prints: DataFrame) -> DataFrame:
    """Peak of the running capital by market, net PnL of the taken prints and its share of the peak; null where a cost is unknown."""
    opens = prints.where("taken").select("ticker", F.col("day").alias("ts"), (F.col("size").cast("bigint") * F.col("price_cents")).alias("cap"))
    settled = prints.groupBy("ticker").agg(F.max("day").alias("ts"))
    peak = running_capital(opens, settled, "ticker").groupBy("ticker").agg(F.max("capital").alias("peak_capital"))
    sums = prints.where("taken").groupBy("ticker").agg(F.sum(F.col("size").cast("bigint") * F.col("price_cents")).alias("turnover"), *_sums(F.lit(True), "net_cents"))
    return peak.join(sums, "ticker").select("ticker", "peak_capital", "turnover", "net_cents", F.round(F.col("net_cents") / F.col("peak_capital"), 6).alias("return"))
