"""Sinks of normalised events and of reports, both laid out by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "trace_id bigint, source string, entity_id bigint, kind string, mono_ns bigint, seq bigint, sid bigint, epoch int, ts timestamp_ntz, date date"


def write_events(events: DataFrame, path: str) -> None:
    """One JSON line for each event, in a folder for each date; fields that an event lacks are left out of its line."""
    events.withColumn("date", F.col("ts").cast("date")).write.partitionBy("date").mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def write_report(report: DataFrame, path: str, day: str) -> None:
    """A report's rows in the folder of their date (column `day`); days that the report does not have stay as they are."""
    report.withColumn("date", F.col(day).cast("date")).write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
