"""Exact quantiles of groups of any size: counts by value, dealt out by ranges of the value, and running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.slices import over


def quantiles(rows: DataFrame, keys: tuple[str, ...], value: str, wanted: dict[str, float], whole: bool = False, slices: int | None = None) -> DataFrame:
    """keys, n and a column for each wanted share: exact quantiles of the values of each group, nulls left out; groups without values do not appear.

    Between two elements the quantile is interpolated, or with `whole` it is the element at index min(n - 1, trunc(p n)). A
    value is counted before it is shuffled, groups are cut by ranges of the value, and of each group the one or two rows
    that hold the wanted ranks are all that is brought together: no group is one task's sort or one buffer."""
    own = tuple(f"_k{i}" for i in range(len(keys))) or ("_k",)
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=False)] or [F.lit(0).alias("_k")]
    counts = rows.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("_v")).groupBy(*own, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = over(counts, own, ("_v",), slices, sums={"_upto": F.col("_n")})
    totals = ranked.groupBy(*own).agg(F.max("_upto").alias("_all")).select(*(F.col(o).alias(f"_t{o}") for o in own), "_all")
    same = F.lit(True)
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"_t{o}"))
    met = ranked.join(totals, same)

    def at(rank: Column) -> Column:
        return (rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto"))

    place = lambda p: (F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p))) if whole else (F.col("_all") - 1) * F.lit(p)).cast("double")
    low, high = (lambda p: F.floor(place(p)) + 1), (lambda p: F.ceil(place(p)) + 1)
    hit = F.lit(False)
    for p in wanted.values():
        hit = hit | at(low(p)) | at(high(p))
    picked = [x for n, p in wanted.items() for x in (F.max(F.when(at(low(p)), F.col("_v"))).alias(f"_l_{n}"), F.max(F.when(at(high(p)), F.col("_v"))).alias(f"_h_{n}"))]
    found = met.where(hit).groupBy(*own, "_all").agg(*picked)
    between = lambda n, p: F.col(f"_l_{n}") if whole else F.col(f"_l_{n}") + (place(p) - F.floor(place(p))) * (F.col(f"_h_{n}") - F.col(f"_l_{n}"))
    return found.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=False)), F.col("_all").alias("n"), *(between(n, p).alias(n) for n, p in wanted.items()))
