"""Streaming queries, run over all rows that are there; each is checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.plans.book import CLASS, RECOVERY, RUNG_SECONDS, summed
from tapewright.plans.views import load, view, with_views
from tapewright.sources import capture, messages
from tapewright.sources.scratch import place
from tapewright.streaming import streams


def stream_dedupe(spark, sf_dir):
    """Trades of which every third comes twice within the watermark."""
    t = view(spark, sf_dir, "trades").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = t.unionByName(t.where("trade_id % 3 = 0"))
    kept = streams.drained(streams.deduped(streams.source(twice, "trades"), "40 days"), "append", "deduped")
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("contracts"))


def _events(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return streams.source(e, "events")


def stream_rates(spark, sf_dir):
    out = streams.drained(streams.rates(_events(spark, sf_dir), "1 hour", "event_type", "40 days"), "complete", "rates")
    return out.select((F.unix_timestamp("w.start")).alias("start_s"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    out = streams.drained(streams.sessions(_events(spark, sf_dir), "12 hours", "user_id", "40 days"), "complete", "sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


DELAY = "40 days"  # files are read in no order of time: none may count as late
LAGGING, STALE = 2 * 3600, 5 * 3600


def _end(df, key):
    """A row of no key a hundred days behind df: the end of the log, which lets timers of streams that have fallen silent pass."""
    end = df.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 100 day")).alias("ts"))
    fill = {"ts": F.col("ts"), key: F.lit(-1), "nth": F.lit(1)}
    return end.select(*(fill.get(c, F.lit("" if t == "string" else 0)).cast(t).alias(c) for c, t in df.dtypes))


def _frames(spark, sf_dir):
    f = view(spark, sf_dir, "frames").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("epoch", F.col("epoch").cast("int"))
    return streams.numbered(f, "epoch", "sid").fillna("", ["kind", "ticker", "side"]).fillna(0, ["price_cents", "qty"])


def _ordered_frames(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return streams.replayed(f, "arrival", "frames", last=_end(f, "sid"))


def stream_sequence(spark, sf_dir):
    out = streams.drained(streams.sequence_monitor(_ordered_frames(spark, sf_dir), DELAY), "append", "sequence")
    return out.where("sid >= 0").groupBy("sid", "seq_class").agg(F.count(F.lit(1)).alias("n"))


def stream_book(spark, sf_dir):
    out = streams.drained(streams.book_monitor(_ordered_frames(spark, sf_dir), DELAY), "append", "books")
    return out.where("sid >= 0").groupBy("sid", "ticker").agg(F.count(F.lit(1)).alias("messages"), F.count_if("valid").alias("valid_messages"), F.max("levels").alias("most_levels"))


def stream_recovery(spark, sf_dir):
    """Episodes of recovery by stream and the rung they reached."""
    out = streams.drained(streams.recovery_monitor(_ordered_frames(spark, sf_dir), RUNG_SECONDS, delay=DELAY), "append", "recovery")
    return summed(out.where("sid >= 0"))


def stream_heartbeat(spark, sf_dir):
    """How often each source turns ok, lagging and stale."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp").alias("ts"))
    e = streams.numbered(e, "source")
    out = streams.drained(streams.heartbeat_monitor(streams.replayed(e, "arrival", "beats", last=_end(e, "source")), LAGGING, STALE, DELAY), "append", "heartbeat")
    return out.where("source >= 0").groupBy("source", "health").agg(F.count(F.lit(1)).alias("n"), F.max("at_us").alias("last_us"))


CAPTURED = "recv_mono_ns bigint, recv_wall_ns bigint, stream_epoch int, sid_frame bigint, marker string, raw string"


def stream_capture(spark, sf_dir):
    """A capture log read as a stream of files, decoded, and its sequence classes; the recorder numbers the frames of each stream."""
    f = _frames(spark, sf_dir)
    body = F.to_json(F.struct(F.when(F.col("kind") == "snapshot", "orderbook_snapshot").when(F.col("kind") == "delta", "orderbook_delta").otherwise("ok").alias("type"), "sid", "seq", F.struct(F.col("ticker").alias("market_ticker")).alias("msg")))
    rows = f.select(F.col("arrival").alias("recv_mono_ns"), (F.unix_micros("ts") * 1000).alias("recv_wall_ns"), F.col("epoch").alias("stream_epoch"), F.col("nth").alias("sid_frame"), F.lit(None).cast("string").alias("marker"), F.encode(body, "UTF-8").alias("payload"), (F.floor(F.col("arrival") / (7 * streams.ROWS)) * 7 + F.pmod(F.xxhash64("arrival"), F.lit(7))).alias("_of"))
    path = place(spark, "log")
    capture.write(rows.repartitionByRange(f.count() // streams.ROWS + 7, "_of").drop("_of"), path)  # seven files at a time overlap in time
    log = messages.decoded(streams.stream_of(spark, path, CAPTURED, 8).where("marker is null"))
    got = log.select(F.col("stream_epoch").alias("epoch"), F.col("m.sid").alias("sid"), F.col("sid_frame").alias("nth"), F.col("recv_mono_ns").alias("arrival"), F.timestamp_micros(F.expr("recv_wall_ns div 1000")).alias("ts"), F.col("m.seq").alias("seq"))
    out = streams.drained(streams.sequence_monitor(got.where("sid is not null and seq is not null"), DELAY), "append", "captured")
    return out.groupBy("sid", "seq_class").agg(F.count(F.lit(1)).alias("n"), F.sum("arrival").alias("arrivals"))


def stream_latest(spark, sf_dir):
    """The newest event of each user, kept up to date by batches."""
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
    return streams.drained(e, "complete", "latest")


QUERIES = {f.__name__: f for f in (stream_dedupe, stream_rates, stream_sessions, stream_sequence, stream_book, stream_recovery, stream_heartbeat, stream_capture, stream_latest)}
ORACLE_SQL = {
    "stream_dedupe": with_views("trades", "select ticker, count(*) as n, cast(sum(size) as bigint) as contracts from trades group by ticker"),
    "stream_rates": "select epoch_us(date_trunc('hour', ts)) // 1000000 as start_s, event_type, count(*) as n from events group by 1, 2",
    "stream_sessions": """with g as (select *, case when ts <= lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hour then 0 else 1 end as edge from events), s as (select user_id, sum(edge) over (partition by user_id order by ts, event_id) as k from g),
n as (select user_id, k, count(*) as n from s group by 1, 2) select user_id, count(*) as sessions, cast(sum(n) as bigint) as events, max(n) as longest from n group by user_id""",
    "stream_sequence": with_views("frames", ", pm as (select *, max(seq) over (partition by epoch, sid order by arrival rows between unbounded preceding and 1 preceding) as m from frames) select sid, case when m is null then 'First' when seq = m + 1 then 'Ok' when seq <= m then 'Stale' else 'Gap' end as seq_class, count(*) as n from pm group by 1, 2"),
    "stream_heartbeat": f"""with g as (select user_id as source, epoch_us(ts) as t, epoch_us(lag(ts) over w) as p, epoch_us(lead(ts) over w) as n from events window w as (partition by user_id order by ts, event_id)),
h as (select source, t as at_us, 'ok' as health from g where p is null or t - p > {LAGGING * 1000000} union all select source, t + {LAGGING * 1000000}, 'lagging' from g where n is null or n - t > {LAGGING * 1000000}
  union all select source, t + {STALE * 1000000}, 'stale' from g where n is null or n - t > {STALE * 1000000}) select source, health, count(*) as n, max(at_us) as last_us from h group by 1, 2""",
    "stream_recovery": RECOVERY,
    "stream_capture": with_views("frames", CLASS + "select sid, seq_class, count(*) as n, cast(sum(arrival) as bigint) as arrivals from c group by 1, 2"),
    "stream_book": with_views("frames", """, o as (select *, max(seq) over (partition by sid order by arrival rows between unbounded preceding and 1 preceding) as m from frames),
g as (select *, sum(case when seq > m + 1 and kind <> 'snapshot' then 1 else 0 end) over (partition by sid order by arrival) as gaps from o),
s as (select *, max(arrival) filter (kind = 'snapshot') over (partition by sid, ticker order by arrival) as seg from g),
d as (select s.*, b.gaps as at_gaps from s left join s b on b.sid = s.sid and b.arrival = s.seg),
e as (select *, case when kind = 'snapshot' then greatest(qty, 0) when kind = 'delta' and at_gaps = gaps and not coalesce(seq <= m, false) and not coalesce(seq > m + 1, false) then qty end as q from d),
z as (select *, sum(q) over (partition by sid, ticker, seg, side, price_cents order by arrival) as size from e),
n as (select *, min(arrival) filter (q is not null and size < 0) over (partition by sid, ticker, seg order by arrival) as neg from z),
a as (select *, case when q is not null and (neg is null or arrival < neg) then q end as used from n),
px as (select distinct sid, ticker, seg, side, price_cents from a where used is not null),
lv as (select a.sid, a.ticker, a.seg, a.arrival, px.side, px.price_cents, sum(case when a.side = px.side and a.price_cents = px.price_cents then coalesce(a.used, 0) else 0 end) over (partition by a.sid, a.ticker, a.seg, px.side, px.price_cents order by a.arrival) as size from a join px on px.sid = a.sid and px.ticker = a.ticker and px.seg = a.seg),
c as (select sid, ticker, arrival, count(*) filter (size > 0) as levels from lv group by 1, 2, 3)
select a.sid, a.ticker, count(*) as messages, count(*) filter (seg is not null and at_gaps = gaps and (neg is null or a.arrival < neg)) as valid_messages, max(coalesce(levels, 0)) as most_levels from a left join c on c.sid = a.sid and c.ticker = a.ticker and c.arrival = a.arrival group by 1, 2"""),
    "stream_latest": "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id",
}
