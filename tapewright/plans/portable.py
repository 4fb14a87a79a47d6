"""Helpers of the query registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from tapewright.plans.views import view, with_views


def oracle(body: str) -> str:
    """SQL for DuckDB of text that names views in braces."""
    names = list(dict.fromkeys(re.findall(r"\{(\w+)\}", body)))
    plain = re.sub(r"\{(\w+)\}", r"\1", body).strip()
    plain = ", " + plain[5:] if plain[:5].lower() == "with " else plain
    return with_views(" ".join(names), plain)


def over(op: Callable[..., DataFrame], *names: str, **parameters):
    """The query that applies an operator to views."""

    def query(spark, sf_dir):
        return op(*(view(spark, sf_dir, n) for n in names), **parameters)

    return query
