"""Raw capture logs: NDJSON records with a payload as text or as base64, or a marker without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "recv_mono_ns bigint, recv_wall_ns bigint, source_event_time_ms bigint, source string, channel string, source_ticker string, source_sequence bigint, sid bigint, stream_epoch int, marker string, raw string, raw_b64 string, _corrupt string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log or a set of rotated logs, with file and rotation number. Blank lines are left out; lines that are not
    whole JSON objects (the cut-off last line of a live log among them) have `_corrupt` set."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    rotation = F.coalesce(F.regexp_extract("file", r"\.([0-9]+)$", 1).try_cast("int"), F.lit(0))
    parsed = F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # A record without any field that a record must have is no record either: an array, a number, a string.
    return lines.select("file", rotation.alias("rotation"), parsed.alias("r"), "value").select("file", "rotation", "r.*", F.col("value").alias("_line")).withColumn("_corrupt", F.when(F.col("_corrupt").isNotNull() | F.col("recv_mono_ns").isNull(), F.col("_line"))).drop("_line")


def payload() -> Column:
    """The exact bytes that were received."""
    return F.coalesce(F.encode("raw", "UTF-8"), F.unbase64("raw_b64"))


def data(records: DataFrame) -> DataFrame:
    return records.where("_corrupt is null and marker is null").withColumn("payload", payload())


def markers(records: DataFrame) -> DataFrame:
    return records.where("_corrupt is null and marker is not null")


def counts(records: DataFrame) -> DataFrame:
    """Records, markers and corrupt lines; frames lost according to loss markers; whether the log is complete."""
    lost = F.coalesce(F.sum(F.when(F.col("marker") == "loss", F.col("source_sequence"))), F.lit(0))
    return records.agg(
        F.count_if(F.col("_corrupt").isNull() & F.col("marker").isNull()).alias("recorded"), F.count_if(F.col("_corrupt").isNull() & F.col("marker").isNotNull()).alias("markers"),
        F.count_if(F.col("_corrupt").isNotNull()).alias("corrupt"), lost.alias("lost"), F.when(lost > 0, "LOSSY").otherwise("COMPLETE").alias("verdict"),
    )


def write(records: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """One JSON line for each record (column payload: binary): `raw` where it is UTF-8, else `raw_b64`."""
    text = F.is_valid_utf8(F.col("payload").cast("string"))
    out = records.withColumn("raw", F.when(text, F.col("payload").cast("string"))).withColumn("raw_b64", F.when(~text, F.base64("payload"))).drop("payload")
    out.select(F.to_json(F.struct("*"))).write.option("maxRecordsPerFile", rows_a_file).text(path)
