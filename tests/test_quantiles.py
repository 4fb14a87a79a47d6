import random

import numpy as np
import pytest

from tapewright.operators.quantiles import quantiles

P = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_like_numpy(spark, slices):
    """A hot group, groups of one and two values, ties, nulls, a null key, a group of nulls only."""
    rng = random.Random(slices)
    rows = [("hot", rng.randrange(300)) for _ in range(2000)] + [("one", 5), ("two", 1), ("two", 2), ("none", None), (None, 4), (None, 8)] + [("ties", 7)] * 30 + [("hot", None)] * 5
    df = spark.createDataFrame(rows, "k string, v int")
    exact = {r.k: r for r in quantiles(df, ("k",), "v", P, slices=slices).collect()}
    index = {r.k: r for r in quantiles(df, ("k",), "v", P, True, slices).collect()}
    assert set(exact) == set(index) == {"hot", "one", "two", "ties", None}
    for k in exact:
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert exact[k].n == len(v)
        for name, p in P.items():
            assert exact[k][name] == pytest.approx(np.quantile(v, p)) and index[k][name] == v[min(len(v) - 1, int(p * len(v)))]


def test_all_rows_and_none(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "v long")
    assert quantiles(df, (), "v", {"p": 0.25}).first().asDict() == {"n": 101, "p": 25.0}
    assert quantiles(df.limit(0), (), "v", {"p": 0.25}).count() == 0
