"""Total order without a single task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.sources.scratch import written


def numbered(df: DataFrame, name: str, *by: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with a gapless number from 1 in the order of `by`, which must order all rows that differ.

    Rows are dealt out by range and numbered within their task; one count for each task gives the offsets. Equal rows share
    a task, so the result does not depend on how the ranges fall. `then` is applied to the rows in order, before they are
    written: what it derives is not shuffled and what it leaves out is not written; it must keep `_at` and each row's place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(then(dealt) if then else dealt, name)  # ranges come from samples: they must not be drawn twice
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a task
    out = dealt.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_p", "_before")


def carried(rows: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], columns: tuple[str, ...], step: Callable, schema: str, last: bool = False) -> DataFrame:
    """Steps through the rows of each key in order with a carried state: step(state, *columns) -> (state, values); state begins as None.

    For recursions that no window can express. Rows stream through a task, which holds the state of one key at a time and no
    more rows than a batch. Out come the key and the values of each row, or, if `last`, of the last row of each key."""
    names, k = [f.split(" ")[0] for f in schema.split(", ")], len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, value = None, None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row[:k] != at:
                    if last and at is not None:
                        out.append((*at, *value))
                    at, state = row[:k], None
                state, value = step(state, *row[k:])
                if not last:
                    out.append((*at, *value))
            yield pd.DataFrame(out, columns=names)
        if last and at is not None:
            yield pd.DataFrame([(*at, *value)], columns=names)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *by)
    return dealt.select(*keys, *columns).mapInPandas(run, schema)
