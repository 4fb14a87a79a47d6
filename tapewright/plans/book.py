"""Queries over sequenced frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.operators import sequence
from tapewright.plans.views import SQL, fnv_sql, view, with_views

RUNG_SECONDS = 2 * 3600  # the reference's 2 s, scaled to the adapter's clock
SILENCE_SECONDS = 4 * 3600


def _frames(spark, sf_dir):
    return view(spark, sf_dir, "frames")


def seq_class(spark, sf_dir):
    return sequence.classified(_frames(spark, sf_dir)).select("arrival", "sid", "seq", "seq_class")


def seq_gap_report(spark, sf_dir):
    return sequence.gap_report(_frames(spark, sf_dir))


def book_levels(spark, sf_dir):
    return sequence.levels(_frames(spark, sf_dir)).drop("epoch")


def book_validity(spark, sf_dir):
    return sequence.validity(_frames(spark, sf_dir)).drop("epoch")


def book_drop_counts(spark, sf_dir):
    return sequence.labelled(_frames(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def book_depth(spark, sf_dir):
    """The three lowest levels of each side, as the reference truncates."""
    by = Window.partitionBy("sid", "ticker", "side").orderBy("price_cents")
    return sequence.levels(_frames(spark, sf_dir)).withColumn("rank", F.row_number().over(by)).where("rank <= 3").select("sid", "ticker", "side", "price_cents", "size", "rank")


def book_top_of_book(spark, sf_dir):
    return sequence.top_of_book(_frames(spark, sf_dir)).drop("epoch")


def book_checksums(spark, sf_dir):
    return sequence.checksums(_frames(spark, sf_dir)).drop("epoch")


def replay_equivalence(spark, sf_dir):
    """Checksums of the books of three replays: frames dealt out in another way change none, a log that lost frames changes some (planted)."""
    f = _frames(spark, sf_dir)
    logs = (("a", f), ("b", f.repartition(7, "arrival")), ("c", f.where(f"arrival % {LOST_EVERY} <> 3")))
    a, b, c = (sequence.checksums(x).withColumnRenamed("checksum", n) for n, x in logs)
    differ = lambda n: F.count_if(~F.col("a").eqNullSafe(F.col(n)))
    return a.join(b, list(sequence.BOOK), "full_outer").join(c, list(sequence.BOOK), "full_outer").agg(F.count(F.lit(1)).alias("books"), differ("b").alias("differ"), differ("c").alias("differ_by_loss"))


def summed(episodes):
    """By stream and the rung reached: episodes, those that a snapshot ended, escalations (to the second and third rung), further requests, waits."""
    n = F.count(F.lit(1))
    return episodes.groupBy("sid", "rung").agg(
        n.alias("episodes"), F.count_if("recovered").alias("recoveries"), F.sum(F.least("rung", F.lit(2))).cast("bigint").alias("escalations"),
        (n + F.sum("more")).alias("requests"), F.sum("asked").alias("asked_sum"), F.sum("waited_us").alias("waited_us"),
    )


def gap_recovery(spark, sf_dir):
    return summed(sequence.recoveries(_frames(spark, sf_dir), RUNG_SECONDS))


def stream_silence(spark, sf_dir):
    return sequence.silences(view(spark, sf_dir, "messages"), SILENCE_SECONDS).drop("epoch")


def membership(spark, sf_dir):
    return view(spark, sf_dir, "messages").where("kind = 'snapshot'").groupBy("sid", "ticker").agg(F.min("arrival").alias("bound_at"), F.count(F.lit(1)).alias("snapshots"))


K, BACK = 3, 20
LOST_EVERY = 613


def depth_baseline(spark, sf_dir):
    """Messages of each market whose top-3 depth is under and over its trailing mean, and the sum of depths."""
    d, b = F.col("depth"), F.col("baseline")
    return sequence.depth_baseline(_frames(spark, sf_dir), K, BACK).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth"), F.count_if(d < b).alias("under"), F.count_if(d > b).alias("over"), F.round(F.avg("baseline"), 6).alias("mean_baseline"))


def book_crosscheck(spark, sf_dir):
    """Rebuilt books against the last top-of-book row of their market, which stands for a saved page."""
    lv = sequence.levels(_frames(spark, sf_dir)).groupBy(*sequence.BOOK, "valid")
    top = lv.agg(F.max(F.when(F.col("side") == "yes", F.col("price_cents"))).alias("best_yes"), F.max(F.when(F.col("side") == "no", F.col("price_cents"))).alias("best_no"))
    last = view(spark, sf_dir, "l1").groupBy("ticker").agg(F.max_by(F.struct("yes_bid", "yes_ask"), "event_id").alias("s"))
    return sequence.crosschecked(top, last.select("ticker", F.col("s.yes_bid").alias("saved_yes"), (100 - F.col("s.yes_ask")).alias("saved_no"))).drop("epoch")


def membership_intervals(spark, sf_dir):
    return sequence.memberships(view(spark, sf_dir, "messages")).drop("epoch")


CLASS = """, pm as (select *, max(seq) over (partition by epoch, sid order by arrival rows between unbounded preceding and 1 preceding) as m from frames),
c as (select *, case when m is null then 'First' when seq = m + 1 then 'Ok' when seq <= m then 'Stale' else 'Gap' end as seq_class from pm)
"""
_LABEL = CLASS + """, g as (select *, max(arrival) filter (seq_class = 'Gap' and kind <> 'snapshot') over (partition by epoch, sid order by arrival) as last_gap from c),
s as (select *, max(arrival) filter (kind = 'snapshot') over (partition by epoch, sid, ticker order by arrival) as segment from g where kind <> 'control'),
l0 as (select *, case when kind = 'snapshot' then 'snapshot' when seq_class = 'Stale' then 'stale' when seq_class = 'Gap' then 'gap' when segment is null then 'no_book' when last_gap > segment then 'waiting' else 'applied' end as l from s),
d0 as (select *, case when l = 'applied' then qty when l = 'snapshot' and qty > 0 then qty else 0 end as d from l0),
z as (select *, sum(d) over (partition by epoch, sid, ticker, segment, side, price_cents order by arrival) as size from d0),
n as (select *, min(arrival) filter (l = 'applied' and size < 0) over (partition by epoch, sid, ticker, segment) as neg from z),
lab as (select *, case when l = 'applied' and arrival = neg then 'negative' when l = 'applied' and arrival > neg then 'waiting' else l end as label from n)
"""
_VALID = _LABEL + """, seg as (select epoch, sid, ticker, arrival as segment, neg, lead(arrival) over (partition by epoch, sid, ticker order by arrival) as nxt from lab where label = 'snapshot'),
v as (select seg.*, (select min(arrival) from c where c.epoch = seg.epoch and c.sid = seg.sid and seq_class = 'Gap' and kind <> 'snapshot' and arrival > segment) as gap from seg),
val as (select sid, ticker, segment, least(nxt, neg, gap) as "end", case when least(nxt, neg, gap) is null then 'open' when least(nxt, neg, gap) = neg then 'negative_level' when least(nxt, neg, gap) = gap then 'sid_gap' else 'next_snapshot' end as reason from v)
"""
LEVELS = _VALID + """, fin as (select sid, ticker, max(segment) as segment, arg_max(reason, segment) = 'open' as valid from val group by sid, ticker),
lv as (select lab.sid, lab.ticker, valid, side, price_cents, cast(sum(d) as bigint) as size from lab join fin using (sid, ticker, segment) where label in ('snapshot', 'applied') group by all having sum(d) <> 0)
"""

QUERIES = {f.__name__: f for f in (seq_class, seq_gap_report, book_levels, book_validity, book_drop_counts, book_depth, book_top_of_book, book_checksums, replay_equivalence, gap_recovery, stream_silence, membership, depth_baseline, book_crosscheck, membership_intervals)}
_APPLIED = "lab where label in ('snapshot', 'applied')"
#: Sizes of all levels of a segment after each of its messages; `top`: the K best of each side.
TOPS = f"""msg as (select sid, ticker, segment, arrival, row_number() over (partition by sid, ticker, segment order by arrival) as i from {_APPLIED}),
px as (select distinct sid, ticker, segment, side, price_cents from {_APPLIED}), dd as (select sid, ticker, segment, arrival, side, price_cents, sum(d) as d from {_APPLIED} group by all),
sz as (select msg.*, px.side, px.price_cents, sum(coalesce(d, 0)) over (partition by msg.sid, msg.ticker, msg.segment, px.side, px.price_cents order by msg.arrival) as size
  from msg join px using (sid, ticker, segment) left join dd on dd.sid = msg.sid and dd.ticker = msg.ticker and dd.segment = msg.segment and dd.arrival = msg.arrival and dd.side = px.side and dd.price_cents = px.price_cents),
rk as (select *, row_number() over (partition by sid, ticker, segment, i, side order by case when size > 0 then 0 else 1 end, price_cents desc) as k from sz),
top as (select sid, ticker, segment, i, side, price_cents, size from rk where k <= {K} and size > 0)"""
#: The ladder of each stream walked request by request: an episode ends at the next snapshot, or after three rungs without one.
RECOVERY = with_views("frames", _LABEL.rstrip() + f""", q as (select epoch, sid, arrival from lab where label = 'negative' union select epoch, sid, arrival from c where seq_class = 'Gap' and kind <> 'snapshot'),
k as (select epoch, sid, arrival, kind, epoch_us(max(ts) over (partition by epoch, sid order by arrival)) as us from frames),
r as (select k.epoch, k.sid, k.arrival, k.us, (select min(s.arrival) from k s where s.kind = 'snapshot' and s.epoch = k.epoch and s.sid = k.sid and s.arrival > k.arrival) as snap from k join q using (epoch, sid, arrival)),
w as (select r.*, coalesce(s.us - r.us < {3 * RUNG_SECONDS * 1000000}, false) as recovered, s.us as snap_us from r left join k s on s.epoch = r.epoch and s.sid = r.sid and s.arrival = r.snap),
j as (select w.*, case when recovered then (select min(n.arrival) from w n where n.epoch = w.epoch and n.sid = w.sid and n.arrival > w.snap)
  else (select min(n.arrival) from w n where n.epoch = w.epoch and n.sid = w.sid and n.us >= w.us + {3 * RUNG_SECONDS * 1000000}) end as nxt from w),
o as (with recursive o as (select epoch, sid, min(arrival) as arrival from j group by 1, 2 union all select j.epoch, j.sid, j.nxt from o join j using (epoch, sid, arrival) where j.nxt is not null) select * from o),
e as (select j.*, lead(j.arrival) over (partition by epoch, sid order by j.arrival) as upto from o join j using (epoch, sid, arrival)),
x as (select e.*, case when recovered then (snap_us - us) // {RUNG_SECONDS * 1000000} else 3 end as rung, case when recovered then snap_us - us else {3 * RUNG_SECONDS * 1000000} end as waited,
  (select count(*) from j n where n.epoch = e.epoch and n.sid = e.sid and n.arrival > e.arrival and (e.upto is null or n.arrival < e.upto)) as more from e)
select sid, cast(rung as int) as rung, count(*) as episodes, count(*) filter (recovered) as recoveries, cast(sum(least(rung, 2)) as bigint) as escalations, cast(count(*) + sum(more) as bigint) as requests, cast(sum(arrival) as bigint) as asked_sum, cast(sum(waited) as bigint) as waited_us from x group by 1, 2""")
ORACLE_SQL = {
    "book_checksums": with_views("frames", LEVELS + f""", sq as (select sid, ticker, arg_max(seq, arrival) as last_seq from frames group by 1, 2),
t as (select sid, ticker, valid, string_agg((case when side = 'yes' then '0' else '1' end) || ':' || lpad(cast(price_cents as varchar), 3, '0') || ':' || cast(size as varchar), ',' order by (case when side = 'yes' then '0' else '1' end) || ':' || lpad(cast(price_cents as varchar), 3, '0') || ':' || cast(size as varchar)) as l from lv group by 1, 2, 3)
select sid, ticker, {fnv_sql('0', "(cast(valid as varchar) || '|' || cast(last_seq as varchar) || '|' || l)")} as checksum from t join sq using (sid, ticker)"""),
    "depth_baseline": with_views("frames", LEVELS.rstrip() + ", " + TOPS + f""", d as (select msg.*, coalesce(s, 0) as depth from msg left join (select sid, ticker, segment, i, sum(size) as s from top group by all) using (sid, ticker, segment, i)),
b as (select *, avg(depth) over (partition by sid, ticker, segment order by arrival rows between {BACK} preceding and 1 preceding) as base from d)
select ticker, count(*) as n, cast(sum(depth) as bigint) as depth, count(*) filter (depth < base) as under, count(*) filter (depth > base) as over, round(avg(base), 6) as mean_baseline from b group by ticker"""),
    "book_crosscheck": with_views("frames l1", LEVELS + """, t as (select sid, ticker, max(price_cents) filter (side = 'yes') as y, max(price_cents) filter (side = 'no') as n from lv where valid group by 1, 2), p as (select ticker, yes_bid, 100 - yes_ask as no_bid from l1 where event_id in (select max(event_id) from l1 group by ticker))
select sid, count(*) as compared, count(*) filter (y is distinct from yes_bid or n is distinct from no_bid) as diverged from t join p using (ticker) group by sid"""),
    "membership_intervals": with_views("frames", """, s as (select sid, ticker, arrival from frames where kind = 'snapshot'), c as (select sid, ticker, arrival from frames where kind = 'control'),
x as (select s.*, (select min(c.arrival) from c where c.sid = s.sid and c.ticker = s.ticker and c.arrival > s.arrival) as forgotten_at from s) select sid, ticker, min(arrival) as bound_at, forgotten_at from x group by sid, ticker, forgotten_at"""),
    "book_top_of_book": with_views("frames", LEVELS.rstrip() + ", " + TOPS.replace(f"k <= {K}", "k = 1") + """, b as (select msg.*, y.price_cents as best_yes, n.price_cents as best_no from msg left join top y on y.sid = msg.sid and y.ticker = msg.ticker and y.segment = msg.segment and y.i = msg.i and y.side = 'yes'
  left join top n on n.sid = msg.sid and n.ticker = msg.ticker and n.segment = msg.segment and n.i = msg.i and n.side = 'no')
select sid, ticker, segment, arrival, best_yes, best_no, 100 - best_no as yes_ask, coalesce(best_yes >= 100 - best_no, false) as crossed from b"""),
    "seq_class": with_views("frames", CLASS + "select arrival, sid, seq, seq_class from c"),
    "seq_gap_report": with_views("frames", CLASS + "select cast(cast(ts as date) as varchar) as day, count(*) filter (seq_class = 'Gap') as gap_events, cast(cast(coalesce(sum(seq - m - 1) filter (seq_class = 'Gap'), 0) as bigint) as varchar) as missed, count(*) filter (seq_class = 'Stale') as regressions, count(distinct sid) filter (seq_class = 'Gap') as sids_with_gaps from c group by 1"),
    "book_levels": with_views("frames", LEVELS + "select * from lv"),
    "book_validity": with_views("frames", _VALID + "select * from val"),
    "book_drop_counts": with_views("frames", _LABEL + "select label, count(*) as n from lab group by label"),
    "book_depth": with_views("frames", LEVELS + "select * from (select sid, ticker, side, price_cents, size, row_number() over (partition by sid, ticker, side order by price_cents) as rank from lv) where rank <= 3"),
    "gap_recovery": RECOVERY,
    "stream_silence": with_views("frames", f"select sid, count(*) filter (date_diff('microsecond', was, ts) // 1000000 > {SILENCE_SECONDS}) as silences, count(*) as frames from (select *, lag(ts) over (partition by sid order by ts, arrival) as was from frames) group by sid"),
    "membership": with_views("frames", "select sid, ticker, min(arrival) as bound_at, count(*) as snapshots from frames where kind = 'snapshot' group by 1, 2"),
}
_SUMS = ORACLE_SQL["book_checksums"]
_LOSSY = _SUMS.replace(SQL["frames"], f"select * from ({SQL['frames']}) where arrival % {LOST_EVERY} <> 3")
ORACLE_SQL["replay_equivalence"] = f"""select count(*) as books, 0 as differ, count(*) filter (a.checksum is distinct from c.checksum) as differ_by_loss
from ({_SUMS}) a full join ({_LOSSY}) c using (sid, ticker)"""
