"""Market-tape views over the driver's tables: the inputs of the registered queries, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.order import numbered
from tapewright.operators.slices import over
from tapewright.sources.scratch import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# The adapter views, in SQL that both engines run. `tape` comes without its order column here; `prints` is the tape where no
# order is needed, `messages` are the frames where no sequence number is.
_TRADES = """select concat('KX', cast(l_partkey % 20 as varchar(20))) as ticker, concat('FAM', cast(l_partkey % 4 as varchar(20))) as family,
  cast(1 + cast(round(l_extendedprice * 100) as bigint) % 99 as int) as price_cents, cast(l_quantity as int) as size,
  l_returnflag = 'R' as taker_yes, l_shipdate as ts{more} from lineitem"""
_TAPE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

_MESSAGES = """select event_id as arrival, cast(1 as int) as epoch, user_id % 4 as sid, concat('KX', cast(user_id % 20 as varchar(20))) as ticker,
  case when event_type = 'signup' then 'snapshot' when event_type = 'error' then 'control' else 'delta' end as kind,
  case when event_type = 'view' then 'no' else 'yes' end as side, cast(40 + event_id % 10 as int) as price_cents,
  cast(round(value) as bigint) % 13 - case when event_type = 'signup' then 0 else 3 end as qty{seq}, ts
from {events} where event_id % 97 <> 0"""
_SEQ = """,
  {n} + case when event_id >= 500 then 3 else 0 end
    - case when event_id % 211 = 0 then 2 else 0 end as seq"""

SQL = {
    "prints": _TRADES.format(more=""),
    "tape": _TRADES.format(more=f", row_number() over (order by {', '.join(_TAPE_ORDER)}) as tape_id"),
    "settles": "select distinct concat('KX', cast(p_partkey % 20 as varchar(20))) as ticker, p_partkey % 3 % 2 = 0 as yes_wins from part where p_partkey < 20",
    "fees": "select * from (values ('KX', 100, 400, 1), ('KX1', 175, 700, 2), ('KX7', -1, -1, 3)) as f(series_prefix, maker_rate_e4, taker_rate_e4, pos)",
    "quotes": """select o_orderkey as cid, concat('KX', cast(o_custkey % 20 as varchar(20))) as ticker,
  cast(1 + cast(round(o_totalprice * 100) as bigint) % 99 as int) as price_cents, cast(1 + o_orderkey % 40 as int) as count,
  o_orderkey % 2 = 0 as buy_yes, o_orderdate as place_ts,
  case when o_orderkey % 7 = 0 then null else o_orderkey % 50 end as queue_ahead,
  case when o_orderkey % 500 = 0 then null else o_orderdate + interval 30 day end as cancel_ts
from orders""",
    "l1": """select event_id, ts, concat('KX', cast(user_id % 20 as varchar(20))) as ticker,
  case when event_id % 11 = 0 then null else cast(10 + cast(round(value * 100) as bigint) % 80 as int) end as yes_bid,
  case when event_id % 13 = 0 then null else cast(12 + cast(round(value * 100) as bigint) % 80 + user_id % 5 as int) end as yes_ask
from events""",
    "frames": _MESSAGES.format(seq=_SEQ.format(n="row_number() over (partition by user_id % 4 order by event_id)"), events="events"),
    "messages": _MESSAGES.format(seq="", events="events"),
    "dim_market": """select concat('KX', cast(n_nationkey as varchar(20))) as ticker, case when n_nationkey % 10 = 9 then null else concat('EV', cast(n_nationkey % 10 as varchar(20))) end as event_ticker, r_name as series
from nation join region on n_regionkey = r_regionkey where n_nationkey < 18""",
    "gaps": "select cast(event_id as bigint) as gap_id, ts as gap_start, ts + interval 90 second as gap_end from events where event_id % 250 = 100",
    "requests": """select event_id as req_id, ts, user_id as account,
  case event_type when 'click' then 'POST' when 'purchase' then 'DELETE' when 'error' then 'POST' else 'GET' end as method,
  case event_type when 'click' then '/portfolio/events/orders' when 'purchase' then concat('/portfolio/events/orders/', cast(event_id as varchar(20)))
    when 'error' then '/portfolio/events/orders/batched' when 'view' then '/markets?limit=1' else '/portfolio/order_groups' end as path,
  case when event_id % 17 = 0 then 429 when event_id % 23 = 0 then 503 else 200 end as http_status, event_id % 29 = 0 as transport_error
from events""",
    "spans": """select event_id as trace_id, 1000000 + event_id as data_received, 1000000 + event_id + cast(round(value * 1000) as bigint) as data_parsed,
  case when event_id % 19 = 0 then 0 else 2000000 + event_id end as sign_start,
  case when event_id % 31 = 0 then 1 else 2000000 + event_id + cast(round(value * 700) as bigint) end as sign_done
from events""",
    "trades": """select event_id as trade_id, ts, concat('KX', cast(user_id % 20 as varchar(20))) as ticker, cast(10 + cast(round(value * 100) as bigint) % 80 as int) as price_cents,
  cast(1 + cast(round(value) as bigint) % 9 as int) as size, event_id % 2 = 0 as taker_yes from events where event_type = 'purchase'""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the adapter views."""
    if name == "tape":  # the columns of the order are all that is shuffled; the view's own are derived from them in place
        text = _TRADES.format(more=", _at").replace("from lineitem", "from {rows}")
        return numbered(load(spark, sf_dir, "lineitem").select(*_TAPE_ORDER), "tape_id", *_TAPE_ORDER, then=lambda rows: spark.sql(text, rows=rows))
    if name == "frames":  # the numbers of a stream run through slices: its rows are no single task's sort
        events = load(spark, sf_dir, "events").where("event_id % 97 <> 0").selectExpr("event_id", "ts", "user_id", "event_type", "value", "user_id % 4 as _sid")
        rows = over(events, ("_sid",), ("event_id",), sums={"_n": F.lit(1)})
        return written(spark.sql(_MESSAGES.format(seq=_SEQ.format(n="cast(_n as int)"), events="{rows}"), rows=rows), "frames")
    text = SQL[name]
    for t in TABLES:
        if f" {t}" in text:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def with_views(names: str, body: str) -> str:
    """SQL that defines the named views and any further common tables of body, which begins with SELECT or with a CTE list."""
    defs = ",\n".join(f"{n} as ({SQL[n]})" for n in names.split())
    return f"with {defs}{', ' + body[1:] if body.startswith(',') else chr(10) + body}"


def fnv_sql(first_byte: str, text: str) -> str:
    """DuckDB's FNV-1a over a leading byte and the letters of an ASCII text, as a signed 64-bit integer."""
    octets = f"list_concat([14695981039346656037::uhugeint, {first_byte}::uhugeint], list_transform(string_split({text}, ''), lambda c: ascii(c)::uhugeint))"
    h = f"list_reduce({octets}, lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
    return f"cast(case when {h} >= 9223372036854775808::uhugeint then cast({h} as hugeint) - 18446744073709551616::hugeint else cast({h} as hugeint) end as bigint)"
