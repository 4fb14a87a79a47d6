"""Rules over request and order logs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIRE_PREFIX = "/trade-api/v2"
DEFAULT_COST = 10


def endpoint_path(raw: Column) -> Column:
    """Without query, with the wire prefix."""
    p = F.substring_index(raw, "?", 1)
    return F.when(p.startswith(WIRE_PREFIX), p).otherwise(F.concat(F.lit(WIRE_PREFIX), F.when(p.startswith("/"), "").otherwise("/"), p))


def _has(path: Column, *segments: str) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, segments)))


def bucket(method: Column, path: Column) -> Column:
    """Which rate bucket a request draws from. RFQ and order-group reads are writes too."""
    mutating = method != "GET"
    return F.when(_has(path, "order_groups", "rfqs", "quotes"), "write").when(_has(path, "orders"), F.when(_has(path, "batched", "amend", "decrease") | mutating, "write").otherwise("read")).when(_has(path, "block_trades") & mutating, "write").otherwise("read")


def mutation(method: Column, path: Column) -> Column:
    order = (
        F.when(_has(path, "batched"), "order_group").when(_has(path, "amend", "decrease"), "amend_order")
        .when(method == "DELETE", "cancel_order").when(method.isin("POST", "PUT"), "create_order").otherwise("none")
    )
    return F.when(_has(path, "order_groups"), "order_group").when(_has(path, "rfqs", "quotes"), "quote").when(_has(path, "orders"), order).otherwise("none")


def retry(kind: Column, status: Column, transport_error: Column, attempt: Column, most: int) -> dict[str, Column]:
    """retry, needs_reconcile, accounting_drift of a finished request."""
    left = attempt + 1 < most
    ambiguous = transport_error | status.isin(502, 503, 504)
    once = kind.isin("create_order", "amend_order", "order_group", "quote")
    drift = status == 429
    return {"retry": F.when(drift, left).when(ambiguous, ~once & left).otherwise(False), "needs_reconcile": ~drift & ambiguous & once, "accounting_drift": drift}


def backoff_bounds(attempt: Column, base_ms: int, cap_ms: int) -> tuple[Column, Column]:
    """The least and the longest wait before a retry."""
    most = F.least(F.lit(cap_ms).cast("bigint"), F.lit(base_ms).cast("bigint") * F.pow(F.lit(2.0), F.least(attempt, F.lit(30))).cast("bigint"))
    return F.floor(most / 2).cast("bigint"), most


def batch_cost(items: Column, each: Column) -> Column:
    return F.when((items > 0) & (each > 0), items * each).otherwise(0)


def us_between(a: Column, b: Column) -> Column:
    """Microseconds between two nanosecond stamps; -1 where one is missing or they are reversed."""
    return F.when((a == 0) | (b == 0) | (b < a), F.lit(-1.0)).otherwise((b - a) / 1000.0)


def order_status(kind: Column, http_status: Column) -> tuple[Column, Column]:
    """Status and reason of an order record by its kind."""
    status = (
        F.when(kind == "submitted", F.when(http_status >= 400, "rejected").otherwise("sent")).when(kind.isin("expired", "rate_limited", "dropped_full"), "dropped")
        .when(kind.isin("transport_error", "sign_error"), "error").when(kind == "rejected_invalid", "rejected").when(kind == "shadow", "shadow").otherwise("sent")
    )
    reason = F.when(kind == "dropped_full", "queue_full").when(kind == "rejected_invalid", "invalid").when(kind.isin("expired", "rate_limited", "transport_error", "sign_error", "shadow"), kind).otherwise("")
    return status, reason


def folded_reason(reason: Column) -> Column:
    return F.when(reason.startswith("stale"), "stale_signal").when(reason.startswith("dup"), "duplicate").when(reason.startswith("risk"), "risk_check").otherwise("other")


def feed_health(connected: Column, valid: Column, age_s: Column) -> Column:
    return F.when(connected.isNull(), "unknown").when(~connected, "down").when(~valid | (age_s > 3), "degraded").otherwise("up")


def heartbeat(age_s: Column) -> Column:
    return F.when(age_s > 5, "stale").when(age_s > 2, "lagging").otherwise("ok")


def limits_error(which: str, refill: Column, capacity: Column) -> Column:
    """What is wrong with a bucket's limits, or null."""
    half = F.floor(refill / 2)
    return (
        F.when(refill <= 0, F.concat(F.lit(f"{which} refill_rate <= 0 ("), refill.cast("string"), F.lit(")")))
        .when(capacity < half, F.concat(F.lit(f"{which} bucket_capacity "), capacity.cast("string"), F.lit(" < refill_rate/2 ("), half.cast("string"), F.lit(")")))
        .when(capacity > refill * 10, F.concat(F.lit(f"{which} bucket_capacity "), capacity.cast("string"), F.lit(" > refill_rate*10 ("), (refill * 10).cast("string"), F.lit(")")))
    )
