"""Signals that need more than SQL: change points, ordered books walked for size, and fitted models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.order import carried


def cusum(rows: DataFrame, threshold: float, drift: float, alpha: float) -> DataFrame:
    """Two-sided CUSUM and EWMA variance of the mid's moves in each market, causal: each row uses itself and the past only.

    rows: ticker, event_id, ts, mid."""

    def step(state, event_id, mid):
        up, down, var, last = state or (0.0, 0.0, 0.0, None)
        d = 0.0 if last is None else mid - last
        up, down = max(0.0, up + d - drift), max(0.0, down - d - drift)
        var = alpha * d * d + (1 - alpha) * var
        hit = up > threshold or down > threshold
        return (0.0 if hit else up, 0.0 if hit else down, var, mid), (event_id, hit, var)

    return carried(rows, ("ticker",), ("ts", "event_id"), ("event_id", "mid"), step, "ticker string, event_id bigint, change_point boolean, ewma_var double")


def walked(levels: DataFrame, size: int) -> DataFrame:
    """The cost of selling `size` into each book's bids, best first, with a part of the last level.

    levels: sid, ticker, price_cents, size."""
    by = Window.partitionBy("sid", "ticker").orderBy(F.desc("price_cents")).rowsBetween(Window.unboundedPreceding, 0)
    x = levels.withColumn("cum", F.sum("size").over(by)).withColumn("take", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(size) - (F.col("cum") - F.col("size")))))
    return x.groupBy("sid", "ticker").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("price_cents")).alias("proceeds"), F.max("price_cents").alias("best"))


def logistic(rows: DataFrame, features: list[str], label: str, train: str) -> DataFrame:
    """rows with the probability of a regularised logistic model fit on the earlier rows (`train`, a condition)."""
    known = rows.dropna(subset=features)
    v = VectorAssembler(inputCols=features, outputCol="v").transform(known.where(train)).select("v", label)
    model = LogisticRegression(featuresCol="v", labelCol=label, regParam=0.01, maxIter=20).fit(v)
    z = F.lit(float(model.intercept))
    for name, w in zip(features, model.coefficients.toArray().tolist(), strict=True):
        z = z + F.col(name) * w
    return known.withColumn("p", F.round(1 / (1 + F.exp(-z)), 6))


def components(rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """rows with their scores on the first k principal components."""
    v = VectorAssembler(inputCols=features, outputCol="v", handleInvalid="skip").transform(rows)
    out = PCA(k=k, inputCol="v", outputCol="pc").fit(v.select("v")).transform(v)
    return out.select("*", *(F.round(vector_to_array("pc")[i], 6).alias(f"pc{i + 1}") for i in range(k))).drop("v", "pc")
