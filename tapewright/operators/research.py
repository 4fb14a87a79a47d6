"""Market microstructure measures over top-of-book rows and trades.

The research code behind the published figures is absent; formulas marked `chosen` are ours, with their parameters named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.slices import looked, over, sliced
from tapewright.sources.scratch import written

# Why a dwell interval ends.
OBSERVED, STALE, LAST = "OBSERVED_NEXT_VALID_STATE", "RIGHT_CENSORED_STALE_TTL", "RIGHT_CENSORED_LAST_MARKET_OBSERVATION"


def micros(a: str, b: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {a}, {b})")


def _both(trades: DataFrame, book: DataFrame, at: Column, rank: int) -> DataFrame:
    """Trades at a probe time and book rows in one table; `rank` orders trades before (0) or after (2) books of that time."""
    t = trades.select("ticker", at.alias("at"), F.lit(rank).alias("rank"), F.lit(None).cast("bigint").alias("id"), F.struct("*").alias("trade"), F.lit(None).cast("struct<ts: timestamp_ntz, bid: int, ask: int>").alias("book"))
    b = book.select("ticker", F.col("ts").alias("at"), F.lit(1).alias("rank"), F.col("event_id").alias("id"), F.lit(None).cast(t.schema["trade"].dataType).alias("trade"), F.struct(F.col("ts"), F.col("yes_bid").alias("bid"), F.col("yes_ask").alias("ask")).alias("book"))
    return t.unionByName(b)


_PROBED = ("at", "rank", "id")


def as_of(trades: DataFrame, book: DataFrame, at: Column, strict: bool, name: str, slices: int | None = None) -> DataFrame:
    """trades with the last book row of their market before `at` (at or before it unless strict), in column `name`."""
    out = over(_both(trades, book, at, 0 if strict else 2), ("ticker",), _PROBED, slices, before={name: F.col("book")})
    return out.where("trade is not null").select("trade.*", name)


def past_and_future(trades: DataFrame, book: DataFrame, horizons_h: tuple[int, ...], pick: str = "last", slices: int | None = None) -> DataFrame:
    """trades with the strictly past book and, for each horizon, the book row in (t, t + horizon]: the last (chosen) or first.

    All lookups are probes in one order of market and time: each trade has one strictly before its time, and one behind it
    for each horizon. What the probes find is brought together by the trade's number."""
    numbered = written(trades.withColumn("_n", F.monotonically_increasing_id()), "trades")
    hours = lambda h: F.col("ts") + F.expr(f"interval {h} hour")
    wanted = [F.struct(F.lit("past").alias("kind"), F.col("ts").alias("at"), F.lit(0).alias("rank"))]
    if pick == "last":
        wanted += [F.struct(F.lit(f"f{h}").alias("kind"), hours(h).alias("at"), F.lit(2).alias("rank")) for h in horizons_h]
    else:
        wanted += [F.struct(F.lit("first").alias("kind"), F.col("ts").alias("at"), F.lit(2).alias("rank"))]
    probes = numbered.select("ticker", "_n", F.explode(F.array(*wanted)).alias("p")).select("ticker", "p.at", "p.rank", F.lit(None).cast("bigint").alias("id"), "_n", "p.kind")
    books = book.select("ticker", F.col("ts").alias("at"), F.lit(1).alias("rank"), F.col("event_id").alias("id"), F.struct("ts", F.col("yes_bid").alias("bid"), F.col("yes_ask").alias("ask")).alias("book"))
    met = over(probes.unionByName(books, allowMissingColumns=True), ("ticker",), _PROBED, slices, before={"was": F.col("book")}, after={"next": F.col("book")}).where("_n is not null")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    cols = [of("past", "was").alias("past")]
    cols += [of(f"f{h}", "was").alias(f"f{h}") for h in horizons_h] if pick == "last" else [of("first", "next").alias(f"f{h}") for h in horizons_h]
    out = numbered.join(met.groupBy("_n").agg(*cols), "_n").drop("_n")
    for h in horizons_h:
        later = F.col(f"f{h}.ts") > F.col("ts") if pick == "last" else F.col(f"f{h}.ts") <= hours(h)
        out = out.withColumn(f"f{h}", F.when(later, F.col(f"f{h}")))
    return out


def clear_of_gaps(rows: DataFrame, gaps: DataFrame, start: str, end: str, days: int = 2) -> DataFrame:
    """rows whose span meets no capture gap: a range anti-join by day buckets, so neither side is sent whole."""
    day = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    span = F.sequence(F.floor(day(F.col(start)) / days), F.floor(day(F.coalesce(F.col(end), F.col(start))) / days))
    g = gaps.select("gap_start", "gap_end", F.explode(F.sequence(F.floor(day(F.col("gap_start")) / days), F.floor(day(F.col("gap_end")) / days))).alias("gb"))
    met = rows.select("trade_id", start, end, F.explode(span).alias("b")).join(g, (F.col("b") == F.col("gb")) & (F.col(start) < F.col("gap_end")) & (F.coalesce(F.col(end), F.col(start)) > F.col("gap_start")), "left_semi")
    return rows.join(met.select("trade_id").distinct(), "trade_id", "left_anti")


def mid2(book: str) -> Column:
    """Twice the mid, an integer; null when one-sided."""
    return F.col(f"{book}.bid") + F.col(f"{book}.ask")


def state(bid: Column, ask: Column) -> Column:
    return F.when(bid.isNotNull() & ask.isNotNull(), F.when(bid >= ask, "CROSSED").otherwise("TWO_SIDED")).when(bid.isNotNull(), "BID_ONLY").when(ask.isNotNull(), "ASK_ONLY").otherwise("NONE")


_L1 = ("ts", "event_id")


def intervals(l1: DataFrame, slices: int | None = None) -> DataFrame:
    """Each top-of-book row with its state and the time to the market's next row; the last one is right-censored."""
    x = over(l1.withColumn("state", state(F.col("yes_bid"), F.col("yes_ask"))), ("ticker",), _L1, slices, after={"next_ts": F.col("ts")})
    return x.withColumn("dur_us", micros("ts", "next_ts"))


def dwell(l1: DataFrame, ttl_minutes: tuple[int, ...]) -> DataFrame:
    """For each time to live, end reason and day: rows and microseconds; dwell is the time to the next row, at most the TTL."""
    ttl = F.explode(F.array(*(F.lit(m) for m in ttl_minutes))).alias("ttl_min")
    x = intervals(l1).where("state <> 'NONE'").select("*", ttl)
    cap = F.col("ttl_min").cast("bigint") * 60_000_000
    why = F.when(F.col("dur_us").isNull(), LAST).when(F.col("dur_us") > cap, STALE).otherwise(OBSERVED)
    us = F.when(F.col("dur_us").isNull(), 0).otherwise(F.least("dur_us", cap))
    return x.groupBy(F.col("ts").cast("date").cast("string").alias("day"), "ttl_min", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(us).alias("dwell_us"))


def episodes(l1: DataFrame, wide_cents: int, slices: int | None = None) -> DataFrame:
    """Runs of rows with a spread of at least wide_cents (chosen): episode number in the market, first and last time, rows, refill.

    An episode is refilled at the market's first row after it; one that the market's last row ends is censored.
    """
    flag = F.coalesce(F.col("yes_ask") - F.col("yes_bid") >= wide_cents, F.lit(False))
    x = looked(sliced(l1.withColumn("wide", flag), _L1, slices), ("ticker",), _L1, before={"was": F.col("wide")}, after={"next_ts": F.col("ts")})
    x = looked(x.withColumn("edge", (F.col("wide") != F.coalesce("was", F.lit(False))).cast("int")), ("ticker",), _L1, sums={"run": F.col("edge")}).where("wide")
    return x.groupBy("ticker", "run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.max_by("next_ts", "event_id").alias("refill_ts"),
        F.min_by("yes_bid", "event_id").alias("bid0"), F.min_by("yes_ask", "event_id").alias("ask0"), F.min("event_id").alias("first_id"),
    )


def hazard(eps: DataFrame, bins: int, minutes: int, *strata: str) -> DataFrame:
    """Discrete hazard of refill: for each bin of the time since an episode began, how many were at risk and how many refilled."""
    age = F.floor(micros("start_ts", "refill_ts") / (minutes * 60_000_000))
    last = F.least(F.coalesce(age, F.floor(micros("start_ts", "last_ts") / (minutes * 60_000_000))), F.lit(bins - 1))
    x = eps.select(*strata, age.alias("age"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bin"))
    h = x.groupBy(*strata, "bin").agg(F.count(F.lit(1)).alias("at_risk"), F.count_if(F.col("age") == F.col("bin")).alias("events"))
    return h.withColumn("hazard", F.round(F.col("events") / F.col("at_risk"), 6))


def survival(h: DataFrame, *strata: str) -> DataFrame:
    """Cumulative refill, 1 minus the running product of 1 - hazard, over the few bins of each stratum."""
    by = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    left = 1 - F.col("events") / F.col("at_risk")
    dead = F.max((left <= 0).cast("int")).over(by) == 1
    stay = F.when(dead, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(left > 0, left))).over(by)))
    return h.withColumn("refilled", F.round(1 - stay, 6))


def matched(eps: DataFrame, controls: DataFrame, hours: int, lag_hours: int, spreads: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Episodes with their control (chosen): same bid, nearest spread, at most lag_hours earlier. One to one without a second
    round: the nearest control of each episode, then the nearest episode of each control; losers stay unmatched.

    Controls have one of a few spreads, and of those with one bid and spread the latest before an episode is its nearest: an
    as-of join for each spread, so no pairs are made. Time is cut into buckets of `hours`; a control is seen from its own and
    the next one, so a hot bid is many windows."""
    cut = lambda c: F.floor(F.expr(f"timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', {c})") / hours)
    e = eps.select("ticker", F.col("first_id").alias("episode"), "start_ts", "bid0", "ask0")
    e = e.select(F.col("bid0").alias("bid"), F.explode(F.array(*map(F.lit, spreads))).alias("spread"), cut("start_ts").alias("b"), F.col("start_ts").alias("at"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("tie"), F.struct("*").alias("e"))
    c = controls.select("event_id", "ts", F.col("yes_bid").alias("bid"), (F.col("yes_ask") - F.col("yes_bid")).alias("spread"), F.col("yes_ask").alias("cask"))
    c = c.select("bid", "spread", F.explode(F.array(cut("ts"), cut("ts") + 1)).alias("b"), F.col("ts").alias("at"), F.lit(1).alias("rank"), (-F.col("event_id")).alias("tie"), F.struct(F.col("event_id").alias("control"), F.col("ts").alias("cts"), F.col("bid").alias("cbid"), "cask").alias("c"))
    past = Window.partitionBy("bid", "spread", "b").orderBy("at", "rank", "tie").rowsBetween(Window.unboundedPreceding, -1)
    met = e.unionByName(c, allowMissingColumns=True).withColumn("c", F.last("c", ignorenulls=True).over(past)).where("e is not null and c is not null")
    met = met.select("e.*", "c.*").withColumn("lag_us", micros("cts", "start_ts")).where(F.col("lag_us") <= lag_hours * 3_600_000_000)
    near = F.abs((F.col("ask0") - F.col("bid0")) - (F.col("cask") - F.col("cbid"))).alias("near")
    first = met.groupBy("episode").agg(F.min(F.struct(near, "lag_us", "control", "ticker", "bid0", "ask0", "cbid", "cask")).alias("m")).select("episode", "m.*")
    last = first.groupBy("control").agg(F.min(F.struct("near", "lag_us", "episode", "ticker", "bid0", "ask0", "cbid", "cask")).alias("m"))
    return last.select("m.ticker", "m.episode", "control", "m.lag_us", "m.bid0", "m.ask0", "m.cbid", "m.cask")


def kaplan_meier(rows: DataFrame, key: str, duration: str, censored: str) -> DataFrame:
    """For each key and whole duration: at risk, ended, and the share that lasts longer; rows that are censored only leave the risk set."""
    n = rows.groupBy(key, duration).agg(F.count_if(~F.col(censored)).alias("ended"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(key).orderBy(F.desc(duration)).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("at_risk", F.sum("n").over(ahead))
    past = Window.partitionBy(key).orderBy(duration).rowsBetween(Window.unboundedPreceding, 0)
    left = 1 - F.col("ended") / F.col("at_risk")
    gone = F.max((left <= 0).cast("int")).over(past) == 1
    return n.select(key, duration, "at_risk", "ended", F.round(F.when(gone, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(left > 0, left))).over(past))), 6).alias("lasting"))


def tally(rows: DataFrame, channel: str, id: str) -> DataFrame:
    """Rows of a channel by day, with the sum of their ids' hashes, which differs where one row takes another's place."""
    return rows.groupBy(F.lit(channel).alias("channel"), F.coalesce(F.col("ts").cast("date").cast("string"), F.lit("unknown")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(id).cast("decimal(20,0)")).cast("decimal(38,0)").alias("ids"))


def conserved(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against read tallies by channel and day: MISSING days that were not read, EXTRA ones that were not declared."""
    x = manifest.alias("m").join(actual.alias("a"), ["channel", "day"], "full_outer")
    expected, got = F.coalesce("m.n", F.lit(0)), F.coalesce("a.n", F.lit(0))
    state = (
        F.when(F.col("a.n").isNull(), "MISSING").when(F.col("m.n").isNull(), "EXTRA").when(got < expected, "LOST").when(got > expected, "DOUBLED")
        .when(F.col("m.ids") != F.col("a.ids"), "REPLACED").otherwise("EXACT")
    )
    return x.select("channel", "day", expected.alias("expected"), got.alias("actual"), state.alias("state"))


def transitions(l1: DataFrame, slices: int | None = None) -> DataFrame:
    """How often a state follows a state, in each market's order of time."""
    x = over(l1.withColumn("state", state(F.col("yes_bid"), F.col("yes_ask"))), ("ticker",), _L1, slices, before={"was": F.col("state")})
    return x.where("was is not null").groupBy("was", "state").agg(F.count(F.lit(1)).alias("n"))


def utc_rhythm(l1: DataFrame) -> DataFrame:
    """Updates and active market-minutes by hour of the day, from one row for each market and minute."""
    minutes = l1.groupBy("ticker", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    h = minutes.groupBy(F.hour("minute").alias("hour")).agg(F.sum("n").alias("updates"), F.count(F.lit(1)).alias("active_market_minutes"))
    return h.withColumn("rate", F.round(F.col("updates") / F.col("active_market_minutes"), 6))


def in_active_slots(trades: DataFrame, l1: DataFrame, slot: str) -> DataFrame:
    """Trades of each market in slots of time in which its book moved."""
    active = l1.select("ticker", F.date_trunc(slot, "ts").alias("slot")).distinct()
    met = trades.withColumn("slot", F.date_trunc(slot, "ts")).join(active, ["ticker", "slot"], "left_semi")
    return met.groupBy("ticker").agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("contracts"))


def graph_status(markets: DataFrame, dim: DataFrame) -> DataFrame:
    d = dim.select("ticker", "event_ticker", "series", F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "MISSING_MARKET_DIM").when(F.col("event_ticker").isNull(), "MISSING_EVENT_DIM").otherwise("CANONICAL_FAMILY_EVENT")
    return markets.select("ticker").distinct().join(d, "ticker", "left").select("ticker", "event_ticker", "series", status.alias("mapping_status"))


def coverage(channels: dict[str, DataFrame]) -> DataFrame:
    """Market-days, and rows and markets of each channel, by day: one union and two sums instead of outer joins."""
    names = list(channels)
    rows = None
    for name, df in channels.items():
        one = df.groupBy(F.to_date("ts").cast("string").alias("day"), "ticker").agg(F.count(F.lit(1)).alias(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    per = rows.groupBy("day", "ticker").agg(*(F.sum(n).alias(n) for n in names))
    return per.groupBy("day").agg(F.count(F.lit(1)).alias("market_days"), *(F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_rows") for n in names), *(F.count(n).alias(f"{n}_markets") for n in names))


def past_seq(frames: DataFrame) -> DataFrame:
    """frames with the greatest sequence number before each message of its stream."""
    return over(frames, ("epoch", "sid"), ("arrival",), highs={"past": F.col("seq")})


def quality_days(frames: DataFrame, calendar: DataFrame, most: int) -> DataFrame:
    """State and disposition of each calendar day; a day without rows is absent, not clean."""
    day = F.to_date("ts").cast("string").alias("day")
    d = past_seq(frames).groupBy(day).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("seq") > F.col("past") + 1).alias("gaps"), F.count_if(F.col("seq") <= F.col("past")).alias("back"))
    x = calendar.select(day).distinct().join(d, "day", "left")
    absent, bad = F.col("rows").isNull(), (F.col("gaps") > most) | (F.col("back") > most)
    blockers = F.concat(F.when(F.col("gaps") > most, "sequence_gaps;").otherwise(""), F.when(F.col("back") > most, "regressions;").otherwise(""))
    return x.select(
        "day", F.coalesce("rows", F.lit(0)).alias("n_rows"), F.when(absent, "NOT_APPLICABLE").when(bad, "REFUSED").otherwise("PASS").alias("state"),
        F.when(absent, "ABSENT_NOT_CAPTURED").when(bad, "EXCLUDED_DATA_QUALITY").otherwise("INCLUDED_CLEAN_DATE").alias("disposition"), blockers.alias("blockers"),
    )


def evidence(frames: DataFrame) -> DataFrame:
    """Tier of each stream by its share of gaps."""
    g = past_seq(frames).groupBy("sid").agg(F.count_if(F.col("seq") > F.col("past") + 1).alias("gaps"), F.count(F.lit(1)).alias("n"))
    clean = F.col("gaps") == 0
    return g.select("sid", F.when(clean, "A").when(F.col("gaps") * 100 <= F.col("n"), "B").otherwise("C").alias("tier"), F.when(clean, "").otherwise("sequence_gaps").alias("downgrade"))


def estimable(counts: DataFrame, needs: list[tuple[str, str]]) -> DataFrame:
    """Which methods have rows of all inputs that they need. counts: input, n; needs: (method, input), a short list."""
    need = counts.sparkSession.createDataFrame(needs, "method string, input string")
    x = need.join(counts, "input", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    missing = F.count_if(F.col("n") == 0)
    return x.groupBy("method").agg(F.min("n").alias("eligible"), F.when(missing == 0, "EXECUTED").otherwise("NOT_ESTIMABLE").alias("state"), missing.alias("missing_inputs"))
