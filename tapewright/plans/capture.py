"""Queries over capture logs that are written from the frames and trades of the driver's tables, then scanned and decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions.fixedpoint import format_count_fp, format_price_e4
from tapewright.functions.identity import entity_id
from tapewright.operators import sequence
from tapewright.plans.views import view, with_views
from tapewright.sources import capture, messages, sinks
from tapewright.sources.scratch import place


def _log(spark, sf_dir) -> str:
    """Every frame as a message, every fortieth arrival as a marker; one payload in fifty is not UTF-8."""
    f = view(spark, sf_dir, "frames")
    price = format_price_e4(F.col("price_cents") * 100)
    signed = F.when(F.col("qty") < 0, F.concat(F.lit("-"), format_count_fp(-F.col("qty") * 100))).otherwise(format_count_fp(F.col("qty") * 100))
    pair = F.array(F.array(price, format_count_fp(F.greatest(F.col("qty"), F.lit(0)) * 100)))
    none = F.array().cast("array<array<string>>")
    msg = F.struct(F.col("ticker").alias("market_ticker"), F.when((F.col("kind") == "snapshot") & (F.col("side") == "yes"), pair).otherwise(none).alias("yes_dollars_fp"), F.when((F.col("kind") == "snapshot") & (F.col("side") == "no"), pair).otherwise(none).alias("no_dollars_fp"), price.alias("price_dollars"), signed.alias("delta_fp"), "side")
    kind = F.when(F.col("kind") == "snapshot", "orderbook_snapshot").when(F.col("kind") == "delta", "orderbook_delta").otherwise("ok")
    body = F.to_json(F.struct(kind.alias("type"), "sid", "seq", msg.alias("msg")))
    rows = f.select(
        F.col("arrival").alias("recv_mono_ns"), F.lit("ws").alias("source"), F.col("ticker").alias("source_ticker"), F.when(F.col("arrival") % 40 == 0, F.lit(2).cast("bigint")).otherwise(F.col("seq")).alias("source_sequence"), "sid",
        F.col("epoch").alias("stream_epoch"), F.when(F.col("arrival") % 80 == 0, "loss").when(F.col("arrival") % 40 == 0, "gap").alias("marker"),
        F.when(F.col("arrival") % 40 != 0, F.when(F.col("arrival") % 50 == 7, F.concat(F.unhex(F.lit("FF")), F.encode(body, "UTF-8"))).otherwise(F.encode(body, "UTF-8"))).alias("payload"),
    )
    path = place(spark, "capture")
    capture.write(rows, path)
    return path


def capture_counts(spark, sf_dir):
    return capture.counts(capture.scan(spark, _log(spark, sf_dir)))


def capture_bytes(spark, sf_dir):
    """Records by stream with a digest of their payloads; those that are not UTF-8 come back byte for byte too."""
    d = capture.data(capture.scan(spark, _log(spark, sf_dir)))
    return d.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_b64").isNotNull()).alias("not_text"), F.count_if(F.hex(F.substring("payload", 1, 1)) == "FF").alias("led_by_ff"), F.sum(F.conv(F.substring(F.md5("payload"), 1, 8), 16, 10).cast("bigint")).alias("digest"))


def capture_deltas(spark, sf_dir):
    d = messages.decoded(capture.data(capture.scan(spark, _log(spark, sf_dir))))
    return messages.deltas(d).groupBy("ticker", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("delta_fp"), F.sum("price").cast("bigint").alias("price_sum"))


def capture_snapshots(spark, sf_dir):
    d = messages.decoded(capture.data(capture.scan(spark, _log(spark, sf_dir))))
    one = messages.snapshots(d).select("ticker", F.explode(F.concat("yes", "no")).alias("l"))
    return one.where("l.size > 0").groupBy("ticker").agg(F.count(F.lit(1)).alias("levels"), F.sum("l.size").alias("size_fp"))


def capture_sequence(spark, sf_dir):
    """Sequence classes of the decoded envelopes."""
    d = messages.decoded(capture.data(capture.scan(spark, _log(spark, sf_dir))))
    f = d.select(F.col("recv_mono_ns").alias("arrival"), F.col("stream_epoch").alias("epoch"), F.col("m.sid").alias("sid"), F.col("m.seq").alias("seq"), F.col("m.type").alias("kind")).where("sid is not null and seq is not null")
    return sequence.classified(f).groupBy("seq_class").agg(F.count(F.lit(1)).alias("n"))


def event_sink(spark, sf_dir):
    """Frames as normalised events, written by date and read back."""
    f = view(spark, sf_dir, "frames")
    path = place(spark, "events")
    sinks.write_events(f.select(F.col("arrival").alias("trace_id"), F.lit("ws").alias("source"), entity_id(F.lit(1), F.col("ticker")).alias("entity_id"), "kind", (F.col("arrival") * 1000).alias("mono_ns"), F.when(F.col("kind") != "control", F.col("seq")).alias("seq"), "sid", "epoch", "ts"), path)
    e = sinks.read_events(spark, path)
    return e.groupBy(F.col("date").cast("string").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count("seq").alias("numbered"), F.sum("mono_ns").alias("mono_sum"), F.count_distinct("entity_id").alias("entities"))


_D = ", d as (select * from frames where arrival % 40 <> 0), u as (select * from d where arrival % 50 <> 7)\n"
QUERIES = {f.__name__: f for f in (capture_counts, capture_bytes, capture_deltas, capture_snapshots, capture_sequence, event_sink)}
ORACLE_SQL = {
    "event_sink": with_views("frames", "select cast(cast(ts as date) as varchar) as day, kind, count(*) as n, count(*) filter (kind <> 'control') as numbered, cast(sum(arrival * 1000) as bigint) as mono_sum, count(distinct ticker) as entities from frames group by 1, 2"),
    "capture_counts": with_views("frames", "select count(*) filter (arrival % 40 <> 0) as recorded, count(*) filter (arrival % 40 = 0) as markers, 0 as corrupt, cast(sum(2) filter (arrival % 80 = 0) as bigint) as lost, 'LOSSY' as verdict from frames"),
    "capture_bytes": with_views("frames", _D + r""", j as (select *, printf('[["%d.%04d","%d.00"]]', price_cents // 100, price_cents % 100 * 100, greatest(qty, 0)) as lv from d),
b as (select *, printf('{"type":"%s","sid":%d,"seq":%d,"msg":{"market_ticker":"%s","yes_dollars_fp":%s,"no_dollars_fp":%s,"price_dollars":"%d.%04d","delta_fp":"%s%d.00","side":"%s"}}', case kind when 'snapshot' then 'orderbook_snapshot' when 'delta' then 'orderbook_delta' else 'ok' end, sid, seq, ticker,
  case when kind = 'snapshot' and side = 'yes' then lv else '[]' end, case when kind = 'snapshot' and side = 'no' then lv else '[]' end, price_cents // 100, price_cents % 100 * 100, case when qty < 0 then '-' else '' end, abs(qty), side) as body from j),
p as (select sid, arrival, case when arrival % 50 = 7 then '\xFF'::blob || encode(body) else encode(body) end as payload from b)
select sid, count(*) as n, count(*) filter (arrival % 50 = 7) as not_text, count(*) filter (arrival % 50 = 7) as led_by_ff, cast(sum(cast('0x' || substr(md5(payload), 1, 8) as bigint)) as bigint) as digest from p group by sid"""),
    "capture_deltas": with_views("frames", _D + "select ticker, side, count(*) as n, cast(sum(qty * 100) as bigint) as delta_fp, cast(sum(price_cents * 100) as bigint) as price_sum from u where kind = 'delta' group by 1, 2"),
    "capture_snapshots": with_views("frames", _D + "select ticker, count(*) as levels, cast(sum(qty * 100) as bigint) as size_fp from u where kind = 'snapshot' and qty > 0 group by 1"),
    "capture_sequence": with_views("frames", _D + ", pm as (select *, max(seq) over (partition by epoch, sid order by arrival rows between unbounded preceding and 1 preceding) as m from u) select case when m is null then 'First' when seq = m + 1 then 'Ok' when seq <= m then 'Stale' else 'Gap' end as seq_class, count(*) as n from pm group by 1"),
}
