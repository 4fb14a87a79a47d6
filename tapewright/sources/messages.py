"""Typed tables from exchange messages: one JSON object each, told apart by `type`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.fixedpoint import parse_count_fp, parse_delta_fp, parse_price_e4

_S = "string"
ENVELOPE = (
    "type string, sid bigint, seq bigint, code int, msg struct<market_ticker: string, yes_dollars_fp: array<array<string>>, no_dollars_fp: array<array<string>>, price_dollars: string, delta_fp: string, side: string, "
    "client_order_id: string, ts_ms: bigint, yes_bid_dollars: string, yes_ask_dollars: string, last_price_dollars: string, volume_fp: string, yes_price_dollars: string, no_price_dollars: string, count_fp: string, "
    "taker_outcome_side: string, taker_side: string, trade_id: string, event_type: string, settlement_value: string, code: int>"
)
# Lifecycle states by event type.
STATES = {"created": "Created", "open": "Open", "active": "Open", "paused": "Paused", "closed": "Closed", "determined": "Determined", "settled": "Settled"}


def envelope(raw: Column) -> Column:
    """The parsed message; null for anything that is not an object of the expected shape."""
    return F.from_json(raw, ENVELOPE, {"mode": "PERMISSIVE"})


def decoded(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with m, the parsed message. Parsed once; the tables below are projections."""
    return rows.withColumn("m", envelope(F.col(raw)))


def levels(pairs: Column) -> Column:
    """Levels of [price, size] texts: a pair of other than two elements, or one that does not parse, is left out."""
    parsed = F.transform(pairs, lambda p: F.when(F.size(p) == 2, F.struct(parse_price_e4(F.get(p, 0)).alias("price"), parse_count_fp(F.get(p, 1)).alias("size"))))
    return F.array_sort(F.filter(parsed, lambda x: x.isNotNull() & x["price"].isNotNull() & x["size"].isNotNull()))


def snapshots(d: DataFrame) -> DataFrame:
    return d.where("m.type = 'orderbook_snapshot'").select("*", F.col("m.msg.market_ticker").alias("ticker"), levels(F.col("m.msg.yes_dollars_fp")).alias("yes"), levels(F.col("m.msg.no_dollars_fp")).alias("no"))


def deltas(d: DataFrame) -> DataFrame:
    """Price and delta must parse; any side but `no` is yes; an empty client_order_id is null."""
    x = d.where("m.type = 'orderbook_delta'").select("*", F.col("m.msg.market_ticker").alias("ticker"), parse_price_e4(F.col("m.msg.price_dollars")).alias("price"), parse_delta_fp(F.col("m.msg.delta_fp")).alias("delta"), F.when(F.col("m.msg.side") == "no", "no").otherwise("yes").alias("side"), F.nullif(F.col("m.msg.client_order_id"), F.lit("")).alias("client_order_id"))
    return x.where("price is not null and delta is not null")


def tickers(d: DataFrame) -> DataFrame:
    p = lambda n: parse_price_e4(F.col(f"m.msg.{n}"))
    return d.where("m.type = 'ticker'").select("*", F.col("m.msg.market_ticker").alias("ticker"), p("yes_bid_dollars").alias("bid"), p("yes_ask_dollars").alias("ask"), p("last_price_dollars").alias("last"), parse_count_fp(F.col("m.msg.volume_fp")).alias("volume"))


def trades(d: DataFrame) -> DataFrame:
    """The yes price, else ten thousand less the no price, else 0 with price_ok false."""
    yes, no = parse_price_e4(F.col("m.msg.yes_price_dollars")), parse_price_e4(F.col("m.msg.no_price_dollars"))
    price = F.coalesce(yes, F.lit(10000) - no)
    return d.where("m.type = 'trade'").select("*", F.col("m.msg.market_ticker").alias("ticker"), F.coalesce(price, F.lit(0)).alias("price"), price.isNotNull().alias("price_ok"), F.coalesce(parse_count_fp(F.col("m.msg.count_fp")), F.lit(0)).alias("size"), F.when(F.coalesce(F.col("m.msg.taker_outcome_side"), F.col("m.msg.taker_side")) == "no", "no").otherwise("yes").alias("taker"), F.col("m.msg.trade_id").alias("trade_id"))


def lifecycles(d: DataFrame) -> DataFrame:
    state = F.lit("Unknown")
    for k, v in STATES.items():
        state = F.when(F.col("m.msg.event_type") == k, v).otherwise(state)
    return d.where("m.type in ('market_lifecycle', 'market_lifecycle_v2')").select("*", F.col("m.msg.market_ticker").alias("ticker"), state.alias("state"), F.when(state == "Unknown", F.col("m.msg.event_type")).alias("unknown_type"), parse_price_e4(F.col("m.msg.settlement_value")).alias("settlement"))


def error_counts(d: DataFrame) -> DataFrame:
    code = F.coalesce("m.code", "m.msg.code")
    return d.agg(F.count_if(F.col("m.type") == "error").alias("errors"), F.count_if((F.col("m.type") == "error") & (code == 25)).alias("overflows"))
