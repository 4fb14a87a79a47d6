"""Extension points: features, models and policies as functions of DataFrames, with lineage and quarantine."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIKES = 3


def features(events: DataFrame, **columns: Column) -> DataFrame:
    """Event rows -> trace_id and an array of doubles; the trace of an event is carried along."""
    return events.select("trace_id", F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns.values())).alias("values"))


def linear_model(rows: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """Features -> signals: side and strength of those beyond the threshold. Stays in the JVM."""
    score = F.aggregate(F.zip_with("values", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("score", score).where(F.abs("score") >= threshold).select("trace_id", F.when(F.col("score") > 0, "buy").otherwise("sell").alias("side"), F.abs("score").alias("strength"))


def orphans(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows whose trace does not occur in the stage before: there should be none."""
    return later.join(earlier.select("trace_id").distinct(), "trace_id", "left_anti")


def quarantined(rows: DataFrame, key: str, order: str, step: Callable[[float], float], value: str) -> DataFrame:
    """Runs a user's function over all rows: key, at, result, status. A key whose function fails STRIKES times in a row is shut off:
    its later rows are marked and have no result, and other keys go on. value is the column that the function gets.

    Failures do not depend on order, so the function runs in batches of any rows; which key is shut off from where is a window."""

    @F.pandas_udf("result double, status string")
    def tried(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values.tolist():
            try:
                out.append((float(step(v)), "ok"))
            except Exception as e:  # noqa: BLE001  whatever the user's function raises
                out.append((None, type(e).__name__))
        return pd.DataFrame(out, columns=["result", "status"]).astype({"result": "float64"})

    by = Window.partitionBy("key").orderBy("at")
    t = rows.select(F.col(key).alias("key"), F.col(order).alias("at"), tried(F.col(value)).alias("r")).select("key", "at", "r.*")
    failures = F.count_if(F.col("status") != "ok").over(by.rowsBetween(1 - STRIKES, 0))
    t = t.withColumn("struck", F.when(failures == STRIKES, F.col("at")))
    off = F.col("at") > F.min("struck").over(by.rowsBetween(Window.unboundedPreceding, 0))
    off = F.coalesce(off, F.lit(False))
    return t.select("key", "at", F.when(~off, F.col("result")).alias("result"), F.when(off, "quarantined").otherwise(F.col("status")).alias("status"))
