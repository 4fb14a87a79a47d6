"""Small files: trade tapes, fee schedules, saved market, book and limits pages, ops events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.fixedpoint import parse_count_fp, parse_price_e4
from tapewright.sources.messages import levels

_TAPE = "t string, ts bigint, tk string, fam string, p int, c int, y int, yes int"
OPS = "type string, ts_ms bigint, source string, strategy string, ticker string, status string, reason string, price int, size int, http_status int, value double"


def tape(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trades, settlements) of an NDJSON tape: lines without kind or market, or of another kind, are left out; absent numbers are 0."""
    rows = spark.read.text(path).select(F.from_json("value", _TAPE).alias("r")).select("r.*").where("t is not null and tk is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    trades = rows.where("t = 'trade'").select(zero("ts").alias("ts"), F.col("tk").alias("ticker"), F.coalesce("fam", F.lit("")).alias("family"), zero("p").alias("price_cents"), zero("c").alias("size"), (zero("y") == 1).alias("taker_yes"))
    return trades, rows.where("t = 'settle'").select(zero("ts").alias("ts"), F.col("tk").alias("ticker"), (zero("yes") == 1).alias("yes_wins"))


def fees(spark: SparkSession, path: str) -> DataFrame:
    """series_prefix, maker_rate_e4, taker_rate_e4, pos. `#` lines, short lines and rates that do not begin with a number are left
    out: an unknown fee is never guessed. A numeric beginning counts."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.split("value", ",").alias("f"), "value").where(~F.col("value").startswith("#") & (F.size("f") >= 3))
    rate = lambda i: F.regexp_extract(F.get("f", F.lit(i)), r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    return lines.select(F.trim(F.get("f", F.lit(0))).alias("series_prefix"), rate(1).alias("maker_rate_e4"), rate(2).alias("taker_rate_e4"), "pos").where("maker_rate_e4 is not null and taker_rate_e4 is not null")


def _pages(spark: SparkSession, path: str, a_line: bool) -> DataFrame:
    """Saved pages: a file each, or a line each of files that hold many, as more pages than some thousands should be kept."""
    return spark.read.text(path, wholetext=not a_line)


def markets(spark: SparkSession, path: str, a_line: bool = False) -> DataFrame:
    """Saved pages of the market list."""
    page = "cursor string, markets array<struct<ticker: string, status: string, yes_bid_dollars: string, yes_ask_dollars: string, last_price_dollars: string, volume_fp: string, open_interest_fp: string>>"
    m = _pages(spark, path, a_line).select(F.explode(F.from_json("value", page)["markets"]).alias("m"))
    price = lambda c: parse_price_e4(F.col(f"m.{c}"))
    return m.select("m.ticker", "m.status", price("yes_bid_dollars").alias("bid"), price("yes_ask_dollars").alias("ask"), price("last_price_dollars").alias("last"), parse_count_fp(F.col("m.volume_fp")).alias("volume"), parse_count_fp(F.col("m.open_interest_fp")).alias("open_interest"))


def books(spark: SparkSession, path: str, a_line: bool = False) -> DataFrame:
    """Saved order-book pages: dollar levels, else whole cents, else an empty book; levels ascend."""
    page = "orderbook_fp struct<yes_dollars: array<array<string>>, no_dollars: array<array<string>>>, orderbook struct<yes: array<array<bigint>>, no: array<array<bigint>>>"
    r = _pages(spark, path, a_line).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", page).alias("r"))
    cents = lambda c: F.array_sort(F.transform(c, lambda p: F.struct((F.get(p, 0) * 100).cast("int").alias("price"), (F.get(p, 1) * 100).cast("bigint").alias("size"))))
    none = F.array().cast("array<struct<price: int, size: bigint>>")
    return r.select("file", F.coalesce(levels(F.col("r.orderbook_fp.yes_dollars")), cents("r.orderbook.yes"), none).alias("yes"), F.coalesce(levels(F.col("r.orderbook_fp.no_dollars")), cents("r.orderbook.no"), none).alias("no"))


def limits(spark: SparkSession, path: str, a_line: bool = False) -> DataFrame:
    """Saved limits: all of tier, read and write must be there, else the basic tier stands in and from_server is false."""
    page = "usage_tier string, read struct<refill_rate: bigint, bucket_capacity: bigint>, write struct<refill_rate: bigint, bucket_capacity: bigint>, grants array<string>"
    r = _pages(spark, path, a_line).select(F.from_json("value", page).alias("r"))
    ok = F.col("r.usage_tier").isNotNull() & F.col("r.read.refill_rate").isNotNull() & F.col("r.write.refill_rate").isNotNull() & F.col("r.grants").isNotNull()
    pick = lambda c, d: F.when(ok, F.col(c)).otherwise(d)
    return r.select(pick("r.usage_tier", F.lit("basic")).alias("tier"), pick("r.read.refill_rate", F.lit(200)).alias("read_refill"), pick("r.write.refill_rate", F.lit(100)).alias("write_refill"), ok.alias("from_server"))


def ops_events(spark: SparkSession, path: str) -> DataFrame:
    """Console events; unknown fields are let be, lines that do not parse are left out."""
    return spark.read.text(path).select(F.from_json("value", OPS).alias("r")).select("r.*").where("type is not null")


def last_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n events, newest first."""
    return ops_events(spark, path).orderBy(F.desc("ts_ms"), F.desc("type")).limit(n)
