"""Integrity of sequenced message streams and the books rebuilt from them.

Frames: arrival (total order), epoch, sid, ticker, kind (snapshot, delta, control), side, price_cents, qty, seq, ts. Streams are
(epoch, sid). One snapshot frame carries one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.identity import fnv1a
from tapewright.operators.slices import SLICE, looked, sliced
from tapewright.sources.scratch import written

STREAM = ("epoch", "sid")
BOOK = (*STREAM, "ticker")
SEGMENT = (*BOOK, "segment")
ORDER = ("arrival",)


def classified(frames: DataFrame) -> DataFrame:
    """frames with prev_max and seq_class: First, Ok, Gap (ahead of the next number) or Stale (at or below the largest so far)."""
    return _classes(frames).drop(SLICE)


def _classes(frames: DataFrame) -> DataFrame:
    """`classified` with the slice of arrivals that a frame lies in: what runs over a stream or a book runs in slices."""
    f = looked(sliced(frames, ORDER), STREAM, ORDER, highs={"prev_max": F.col("seq")})
    return f.withColumn("seq_class", F.when(F.col("prev_max").isNull(), "First").when(F.col("seq") == F.col("prev_max") + 1, "Ok").when(F.col("seq") <= F.col("prev_max"), "Stale").otherwise("Gap"))


def gap_report(frames: DataFrame) -> DataFrame:
    """By day: gaps, numbers missed, regressions, and streams with gaps."""
    c = classified(frames)
    gap = F.col("seq_class") == "Gap"
    return c.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count_if(gap).alias("gap_events"), F.coalesce(F.sum(F.when(gap, (F.col("seq") - F.col("prev_max") - 1).cast("decimal(20,0)"))), F.lit(0)).cast("decimal(38,0)").cast("string").alias("missed"),
        F.count_if(F.col("seq_class") == "Stale").alias("regressions"), F.count_distinct(F.when(gap, F.concat_ws(":", *STREAM))).alias("sids_with_gaps"),
    )


def labelled(frames: DataFrame) -> DataFrame:
    """Every snapshot and delta with its segment (arrival of the book's last snapshot), level size and label.

    A delta is `stale` by number; `gap` if it opens a gap, which invalidates every market of the stream (as a gap on a control
    frame does, and one on a snapshot does not); `no_book` before a snapshot; `waiting` after the book was invalidated;
    `negative` if it takes a level below zero, which invalidates the book; otherwise `applied`.
    """
    return _labels(_segments(frames)).drop("next_gap", "next_snapshot", SLICE)


def _segments(frames: DataFrame) -> DataFrame:
    """Snapshots and deltas, classified, with their segment, the arrivals of the stream's last gap so far and of the first behind
    (last_gap, next_gap), and that of the book's next snapshot (next_snapshot)."""
    c = written(_classes(frames), "classes")
    broke = F.when((F.col("seq_class") == "Gap") & (F.col("kind") != "snapshot"), F.col("arrival"))
    shot = F.when(F.col("kind") == "snapshot", F.col("arrival"))
    gaps = looked(c, STREAM, ORDER, before={"last_gap": broke}, after={"next_gap": broke}).withColumn("last_gap", F.coalesce(broke, "last_gap"))
    rows = looked(gaps.where("kind <> 'control'"), BOOK, ORDER, before={"segment": shot}, after={"next_snapshot": shot}, source=c.where("kind <> 'control'"))
    return rows.withColumn("segment", F.coalesce(shot, "segment"))


def _labels(rows: DataFrame) -> DataFrame:
    """Rows of `_segments` (whole segments) with label, d, size and negative, the arrival at which the segment falls below zero."""
    first = (
        F.when(F.col("kind") == "snapshot", "snapshot").when(F.col("seq_class") == "Stale", "stale").when(F.col("seq_class") == "Gap", "gap")
        .when(F.col("segment").isNull(), "no_book").when(F.col("last_gap") > F.col("segment"), "waiting").otherwise("applied")
    )
    c = rows.repartition(*SEGMENT).withColumn("label", first)
    c = c.withColumn("d", F.when(F.col("label") == "applied", F.col("qty")).when((F.col("label") == "snapshot") & (F.col("qty") > 0), F.col("qty")).otherwise(0))
    by_level = Window.partitionBy(*SEGMENT, "side", "price_cents").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("size", F.sum("d").over(by_level))
    c = c.withColumn("negative", F.min(F.when((F.col("label") == "applied") & (F.col("size") < 0), F.col("arrival"))).over(Window.partitionBy(*SEGMENT)))  # no order: no second sort
    return c.withColumn("label", F.when((F.col("label") == "applied") & (F.col("arrival") == F.col("negative")), "negative").when((F.col("label") == "applied") & (F.col("arrival") > F.col("negative")), "waiting").otherwise(F.col("label")))


def last_gaps(frames: DataFrame) -> DataFrame:
    return classified(frames).where("seq_class = 'Gap' and kind <> 'snapshot'").select(*STREAM, "arrival")


def validity(frames: DataFrame) -> DataFrame:
    """Each segment of each book: where it begins and ends, and why: next_snapshot, sid_gap, negative_level or open."""
    end = F.least("next_snapshot", "negative", "next_gap")
    why = F.when(end.isNull(), "open").when(end == F.col("negative"), "negative_level").when(end == F.col("next_gap"), "sid_gap").otherwise("next_snapshot")
    return _labels(_segments(frames)).where("label = 'snapshot'").select(*BOOK, "segment", end.alias("end"), why.alias("reason"))


def levels(frames: DataFrame) -> DataFrame:
    """Level sizes of each book's last segment as it stood when it was last valid, and whether it is valid at the end."""
    rows = written(_labels(_segments(frames).where("next_snapshot is null")).where("label in ('snapshot', 'applied')"), "last")
    last = rows.where("label = 'snapshot'").select(*BOOK, F.expr("negative is null and next_gap is null").alias("valid"))
    return rows.join(last, list(BOOK)).groupBy(*BOOK, "valid", "side", "price_cents").agg(F.sum("d").alias("size")).where("size <> 0")


def best_sizes(lv: DataFrame) -> DataFrame:
    """Best bid and ask of each book with levels on both sides, and the sizes there. The ask is what the best no bid implies."""
    top = lambda side, c: F.max_by(F.when(F.col("side") == side, F.col(c)), F.when(F.col("side") == side, F.col("price_cents")))
    b = lv.groupBy(*BOOK).agg(top("yes", "price_cents").alias("bid"), top("yes", "size").alias("bid_size"), (100 - top("no", "price_cents")).alias("ask"), top("no", "size").alias("ask_size"))
    return b.where("bid is not null and ask is not null")


def _messages() -> WindowSpec:
    return Window.partitionBy(*SEGMENT).orderBy("arrival")


def live(frames: DataFrame) -> DataFrame:
    """Each message of a segment that changed the book, with the size of its level after it, and the set of live levels of each side as bits.

    A message that fills or empties a level toggles the bit of its price, and the exclusive or of all toggles so far is the set
    of prices that have contracts: two numbers a side (yes_0, yes_64, no_0, no_64), for prices of 0 to 127 cents."""
    rows = labelled(frames).where("label in ('snapshot', 'applied')").select(*SEGMENT, "arrival", "side", "price_cents", F.col("size").cast("bigint").alias("size"))
    was = F.lag("size").over(Window.partitionBy(*SEGMENT, "side", "price_cents").orderBy("arrival"))
    rows = rows.withColumn("bit", F.when((F.col("size") > 0) != F.coalesce(was > 0, F.lit(False)), F.expr("shiftleft(1L, price_cents % 64)")).otherwise(F.lit(0).cast("bigint")))
    so_far = _messages().rowsBetween(Window.unboundedPreceding, 0)
    sets = {f"{s}_{w}": F.bit_xor(F.when((F.col("side") == s) & (F.floor(F.col("price_cents") / 64) * 64 == w), F.col("bit")).otherwise(0)).over(so_far) for s in ("yes", "no") for w in (0, 64)}
    return rows.withColumns(sets).drop("bit")


def highest(low: str, high: str) -> Column:
    """The highest price in a set of levels; null for none."""
    top = lambda c: F.length(F.bin(c)) - 1
    return F.when(F.col(high) != 0, top(high) + 64).when(F.col(low) != 0, top(low))


def top_of_book(frames: DataFrame) -> DataFrame:
    """Best bids of both sides after each applied message: the highest bits of the sets of live levels."""
    rows = live(frames).withColumn("best_yes", highest("yes_0", "yes_64").cast("bigint")).withColumn("best_no", highest("no_0", "no_64").cast("bigint"))
    ask = 100 - F.col("best_no")
    return rows.select(*SEGMENT, "arrival", "best_yes", "best_no", ask.alias("yes_ask"), F.coalesce(F.col("best_yes") >= ask, F.lit(False)).alias("crossed"))


def _tops(rows: DataFrame, k: int) -> DataFrame:
    """rows of `live` with `tops`, the k highest live levels of each side (structs of side and price): the highest bit is taken k times."""
    found = []
    for side in ("yes", "no"):
        for i in range(k):
            p = f"{side}_p{i}"
            rows = rows.withColumn(p, highest(f"{side}_0", f"{side}_64"))
            for w in (0, 64):
                taken = F.expr(f"shiftleft(1L, {p} - {w})")
                rows = rows.withColumn(f"{side}_{w}", F.when(F.floor(F.col(p) / 64) * 64 == w, F.col(f"{side}_{w}").bitwiseXOR(taken)).otherwise(F.col(f"{side}_{w}")))
            found.append(F.struct(F.lit(side).alias("side"), F.col(p).alias("price_cents")))
    return rows.withColumn("tops", F.filter(F.array(*found), lambda x: x["price_cents"].isNotNull()))


def _sized(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (segment, side, price_cents, arrival and more) with `size`, that of the level after the message `arrival`: an as-of by level."""
    level = (*SEGMENT, "side", "price_cents")
    updates = rows.select(*level, "arrival", F.lit(0).alias("rank"), "size")
    both = updates.unionByName(probes.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    past = Window.partitionBy(*level).orderBy("arrival", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("size", F.coalesce(F.last("size", ignorenulls=True).over(past), F.lit(0))).where("rank = 1").drop("rank")


def _by_side(value: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("side") == s, value)), F.lit(0)).alias(f"{s}_depth") for s in ("yes", "no")]


def _top_levels(frames: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The messages of `live`, and for each message its k best levels of each side with their sizes (levels), and yes_depth, no_depth."""
    rows = written(live(frames), "live")  # read by messages, levels and probes
    messages = rows.select(*SEGMENT, "arrival")
    sized = _sized(rows, _tops(rows, k).select(*SEGMENT, "arrival", F.explode("tops").alias("x")).select(*SEGMENT, "arrival", "x.*"))
    tops = sized.groupBy(*SEGMENT, "arrival").agg(F.collect_list(F.struct("side", "price_cents", "size")).alias("levels"), *_by_side(F.col("size")))  # 2 k levels
    zero = F.lit(0).cast("bigint")
    return rows, messages.join(tops, [*SEGMENT, "arrival"], "left").withColumns({c: F.coalesce(c, zero) for c in ("yes_depth", "no_depth")})


def top_depths(frames: DataFrame, k: int) -> DataFrame:
    """Depth of the k best levels of each side after each applied message."""
    return _top_levels(frames, k)[1].drop("levels")


def depth_baseline(frames: DataFrame, k: int, back: int) -> DataFrame:
    """Top-k depth of both sides after each message, and its mean over up to `back` messages before (chosen); null for the first."""
    before = Window.partitionBy(*BOOK, "segment").orderBy("arrival").rowsBetween(-back, -1)
    depth = F.col("yes_depth") + F.col("no_depth")
    return top_depths(frames, k).select(*BOOK, "segment", "arrival", depth.alias("depth"), F.avg(depth).over(before).alias("baseline"))


def crosschecked(top: DataFrame, saved: DataFrame) -> DataFrame:
    """Best prices of rebuilt books against saved ones, null-safe: how many were compared and how many diverge, by stream.

    top: epoch, sid, ticker, valid, best_yes, best_no; only valid books count. saved: ticker, saved_yes, saved_no."""
    x = top.where("valid").join(saved, "ticker")
    same = F.col("best_yes").eqNullSafe(F.col("saved_yes")) & F.col("best_no").eqNullSafe(F.col("saved_no"))
    return x.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("compared"), F.count_if(~same).alias("diverged"))


def memberships(frames: DataFrame) -> DataFrame:
    """Intervals in which a market is a member of a stream: from the snapshot that binds it to the control frame that forgets it."""
    w = Window.partitionBy(*BOOK).orderBy("arrival")
    f = frames.where("kind in ('snapshot', 'control')").withColumn("was", F.lag("kind").over(w))
    bind, end = (F.col("kind") == "snapshot") & ~F.col("was").eqNullSafe(F.lit("snapshot")), (F.col("kind") == "control") & (F.col("was") == "snapshot")
    f = f.where(bind | end).withColumn("forgotten_at", F.lead("arrival").over(w))
    return f.where("kind = 'snapshot'").select(*BOOK, F.col("arrival").alias("bound_at"), "forgotten_at")


def checksums(frames: DataFrame) -> DataFrame:
    """A hash of each book's final state: validity, last number, sorted yes and no levels."""
    last = frames.groupBy(*BOOK).agg(F.max_by("seq", "arrival").alias("last_seq"))
    lv = levels(frames).groupBy(*BOOK, "valid").agg(F.sort_array(F.collect_list(F.concat_ws(":", F.when(F.col("side") == "yes", "0").otherwise("1"), F.lpad(F.col("price_cents").cast("string"), 3, "0"), "size"))).alias("lv"))
    return lv.join(last, list(BOOK)).select(*BOOK, fnv1a(F.concat_ws("|", F.col("valid").cast("string"), F.col("last_seq").cast("string"), F.array_join("lv", ",")), F.lit(0)).alias("checksum"))


def requests(frames: DataFrame) -> DataFrame:
    """epoch, sid, arrival, clock: each time a snapshot is asked for: a gap but on a snapshot, or a book taken below zero.

    The clock of a stream is the largest time seen in it so far."""
    rows = labelled(frames)
    asked = last_gaps(frames).union(rows.where("label = 'negative'").select(*STREAM, "arrival"))
    return clocked(frames).join(asked, [*STREAM, "arrival"], "left_semi").select(*STREAM, "arrival", "clock")


def clocked(frames: DataFrame) -> DataFrame:
    so_far = Window.partitionBy(*STREAM).orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("clock", F.max("ts").over(so_far))


def recoveries(frames: DataFrame, rung_seconds: int, rungs: int = 3) -> DataFrame:
    """The episodes of recovery of each stream: asked (arrival of the request that opens it), rung, recovered, waited_us, more (requests it took in).

    One ladder runs for a stream at a time: requests while it runs are taken in, any snapshot of the stream ends it, and after
    `rungs` rungs it ends by itself. So each request knows where an episode that it opened would end, and the request that
    opens the next one is the first behind that place: requests point ahead, and those that the first one of its stream
    reaches are picked by doubling the reach of the pointers, a join a round.
    """
    end_us = F.lit(rungs * rung_seconds * 1_000_000)
    asked = requests(frames).withColumn("us", F.unix_micros(F.col("clock").cast("timestamp")))
    snaps = clocked(frames).where("kind = 'snapshot'").select(*STREAM, "arrival", F.unix_micros(F.col("clock").cast("timestamp")).alias("us"))
    ahead = Window.partitionBy(*STREAM).orderBy(F.desc("arrival")).rowsBetween(Window.unboundedPreceding, -1)
    met = asked.select(*STREAM, "arrival", "us", F.lit(None).cast("struct<arrival: bigint, us: bigint>").alias("snap")).unionByName(snaps.select(*STREAM, "arrival", F.lit(None).cast("bigint").alias("us"), F.struct("arrival", "us").alias("snap")))
    met = met.withColumn("next", F.last("snap", ignorenulls=True).over(ahead)).where("us is not null")
    recovered = F.coalesce(F.col("next.us") - F.col("us") < end_us, F.lit(False))
    met = met.select(*STREAM, "arrival", "us", recovered.alias("recovered"), "next")
    until = F.when(F.col("recovered"), F.struct(F.col("next.us").alias("us"), F.col("next.arrival").alias("arrival"))).otherwise(F.struct((F.col("us") + end_us).alias("us"), F.lit(-1).cast("bigint").alias("arrival")))
    met = written(met.withColumn("until", until), "requests")
    # The first request behind each end: ends and requests in one order of clock and arrival.
    places = met.select(*STREAM, F.col("until").alias("at"), F.col("arrival").alias("of"), F.lit(None).cast("bigint").alias("opens"))
    places = places.union(met.select(*STREAM, F.struct("us", "arrival"), F.lit(None).cast("bigint"), F.col("arrival")))
    behind = Window.partitionBy(*STREAM).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    jumps = places.withColumn("to", F.last("opens", ignorenulls=True).over(behind)).where("of is not null").select(*STREAM, F.col("of").alias("arrival"), "to")
    opened = reached(written(jumps, "jumps"), met.groupBy(*STREAM).agg(F.min("arrival").alias("arrival")))
    marks = met.join(opened.withColumn("opens", F.lit(True)), [*STREAM, "arrival"], "left")
    so_far = Window.partitionBy(*STREAM).orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("asked", F.max(F.when(F.col("opens"), F.col("arrival"))).over(so_far))
    first = lambda c: F.max(F.when(F.col("opens"), F.col(c)))
    waited = F.when(F.col("recovered"), F.col("until_us") - F.col("us")).otherwise(end_us)
    out = marks.groupBy(*STREAM, "asked").agg(first("us").alias("us"), first("recovered").alias("recovered"), first("until.us").alias("until_us"), (F.count(F.lit(1)) - 1).alias("more"))
    rung = F.when(F.col("recovered"), F.floor(waited / (rung_seconds * 1_000_000))).otherwise(rungs)
    return out.select(*STREAM, "asked", rung.cast("int").alias("rung"), "recovered", waited.alias("waited_us"), "more")


def reached(jumps: DataFrame, start: DataFrame) -> DataFrame:
    """epoch, sid, arrival: the rows that the start of each stream reaches by its jumps (epoch, sid, arrival, to), start included.

    In each round the jumps double, so what is reached doubles: the rounds are the logarithm of the longest chain."""
    found = written(start.select(*STREAM, "arrival"), "reached")
    while True:
        new = found.join(jumps.where("to is not null"), [*STREAM, "arrival"]).select(*STREAM, F.col("to").alias("arrival"))
        seen = Observation()
        new = written(new.observe(seen, F.count(F.lit(1)).alias("n")), "reached")
        if not seen.get["n"]:
            return found
        found = written(found.union(new), "reached")
        twice = jumps.select(*STREAM, F.col("arrival").alias("to"), F.col("to").alias("on"))
        jumps = written(jumps.join(twice, [*STREAM, "to"]).select(*STREAM, "arrival", F.col("on").alias("to")), "jumps")


def silences(frames: DataFrame, seconds: int) -> DataFrame:
    by = Window.partitionBy(*STREAM).orderBy("ts", "arrival")
    quiet = F.expr("timestampdiff(SECOND, was, ts)") > seconds
    return frames.withColumn("was", F.lag("ts").over(by)).groupBy(*STREAM).agg(F.count_if(quiet).alias("silences"), F.count(F.lit(1)).alias("frames"))


def retreats(frames: DataFrame, k: int, back: int) -> DataFrame:
    """After each applied message but a segment's first, against the book `back` messages (or all there are) before (chosen): the change of the depth of the k
    best levels of each side, and how many of the k levels of then have lost depth."""
    rows, tops = _top_levels(frames, k)
    now = F.struct("levels", "yes_depth", "no_depth")
    then = F.coalesce(F.lag(now, back).over(_messages()), F.first(now).over(_messages().rowsBetween(Window.unboundedPreceding, 0)))
    x = tops.withColumn("then", then).withColumn("i", F.row_number().over(_messages())).where("i > 1")
    key = [*SEGMENT, "arrival"]
    changes = x.select(*key, *((F.col(f"{s}_depth") - F.col(f"then.{s}_depth")).alias(f"{s}_change") for s in ("yes", "no")))
    probes = x.select(*key, F.explode("then.levels").alias("l")).select(*key, "l.side", "l.price_cents", F.col("l.size").alias("then_size"))
    fell = F.col("size") < F.col("then_size")
    lost = _sized(rows, probes).groupBy(*key).agg(*(F.count_if(fell & (F.col("side") == s)).cast("int").alias(f"{s}_lost") for s in ("yes", "no")))
    return changes.join(lost, key, "left").fillna(0, ["yes_lost", "no_lost"])
