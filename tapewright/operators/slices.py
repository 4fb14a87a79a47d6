"""Windows over keys of any length, by slices of their order.

A window sorts all rows of a key in one task. Here rows are dealt out by ranges of the order itself, windows run within a key's
slice, each key leaves one summary row a slice, and what lies outside a row's slice comes in by a join with the running
summary. A key with a third of all rows is spread over as many tasks as there are slices; the summaries of one key are as
many rows as there are slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.sources.scratch import written

SLICE = "_slice"


def sliced(df: DataFrame, by: tuple[str, ...], slices: int | None = None) -> DataFrame:
    """df with the number of the range of `by` that a row lies in; as many ranges as shuffle partitions unless `slices` says."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *by).withColumn(SLICE, F.spark_partition_id()), "slices")  # ranges come from samples: they must not be drawn twice


def looked(df: DataFrame, key: tuple[str, ...], by: tuple[str, ...], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, lows: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, source: DataFrame | None = None) -> DataFrame:
    """df (of `sliced` with the same `by`, which orders all rows whose values matter) with columns over all rows of the key:

    before: the last value that is not null in a row before this one; after: the first in a row behind it; sums: the running
    sum, this row's included, nulls as nothing; lows, highs: the least and the greatest value in a row before this one.
    source: the same rows from where they are cheap to read (a written table), if df derives more columns from them; the summaries come from there."""
    before, after, sums, lows, highs = before or {}, after or {}, sums or {}, lows or {}, highs or {}
    part = [*key, SLICE]
    local = Window.partitionBy(*part).orderBy(*by)
    turned = Window.partitionBy(*part).orderBy(*(F.desc(c) for c in by)).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    at = F.struct(*by)
    names = {"b": before, "a": after, "s": sums, "m": lows, "h": highs}
    own = {f"_{k}_{n}": v for k, group in names.items() for n, v in group.items()}
    rows = df.withColumns(own)
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    summed = {"b": lambda c: F.max_by(c, known(c)), "a": lambda c: F.min_by(c, known(c)), "s": F.sum, "m": F.min, "h": F.max}
    earlier = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True)
    carried = {"b": lambda c: last(c).over(earlier), "a": lambda c: last(c).over(later), "s": lambda c: F.sum(c).over(earlier), "m": lambda c: F.min(c).over(earlier), "h": lambda c: F.max(c).over(earlier)}
    brought = (rows if source is None else source.withColumns(own)).groupBy(*part).agg(*(summed[c[1]](c).alias(c) for c in own)).select(*(F.col(c).alias(f"_k_{c}") for c in part), *(carried[c[1]](c).alias(f"_o{c}") for c in own))
    past, upto = local.rowsBetween(Window.unboundedPreceding, -1), local.rowsBetween(Window.unboundedPreceding, 0)
    inside = {"b": lambda c: last(c).over(past), "a": lambda c: last(c).over(turned), "s": lambda c: F.sum(c).over(upto), "m": lambda c: F.min(c).over(past), "h": lambda c: F.max(c).over(past)}
    for c in own:
        rows = rows.withColumn(f"_l{c}", inside[c[1]](c))
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    met = rows.join(brought, same)
    here, there = (lambda c: F.col(f"_l{c}")), (lambda c: F.col(f"_o{c}"))
    joined = {"b": lambda c: F.coalesce(here(c), there(c)), "s": lambda c: F.coalesce(here(c), F.lit(0)) + F.coalesce(there(c), F.lit(0)), "m": lambda c: F.least(here(c), there(c)), "h": lambda c: F.greatest(here(c), there(c))}
    out = {c[3:]: joined.get(c[1], joined["b"])(c) for c in own}
    return met.select(*(f"`{c}`" for c in df.columns if c not in out), *(v.alias(n) for n, v in out.items()))


def over(df: DataFrame, key: tuple[str, ...], by: tuple[str, ...], slices: int | None = None, **columns: dict[str, Column]) -> DataFrame:
    """`looked` over freshly dealt slices."""
    return looked(sliced(df, by, slices), key, by, **columns).drop(SLICE)
