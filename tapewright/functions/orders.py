"""Arithmetic and rules of orders and books, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGY_SLOTS = 30


def implied_yes_ask(no_bid: Column) -> Column:
    return F.lit(10000) - no_bid


def crossed(bid: Column, ask: Column) -> Column:
    return F.coalesce(bid >= ask, F.lit(False))


def fee_cents(rate_e4: Column, count: Column, price: Column) -> Column:
    """Fee of one fill in cents, rounded up."""
    exact = rate_e4.cast("bigint") * count * price * (F.lit(100) - price) + 999_999
    return ((exact - exact % 1_000_000) / 1_000_000).cast("bigint")


def risk_cents(count: Column, price: Column, buy: Column) -> Column:
    return count.cast("bigint") * F.when(buy, price).otherwise(100 - price)


def is_bid(buy: Column, yes: Column) -> Column:
    return buy == yes


def yes_cents(kind: Column, buy: Column, yes: Column, price: Column) -> Column:
    """The price on the YES book; a market order rests nowhere and takes the extreme."""
    return F.when(kind == "market", F.when(is_bid(buy, yes), 99).otherwise(1)).otherwise(F.when(yes, price).otherwise(100 - price)).cast("int")


def reject_reason(strategy: Column, action: Column, side: Column, kind: Column, count: Column, price: Column, ticker: Column) -> Column:
    """The first rule that an order intent breaks, or null."""
    limit = kind == "limit"
    return (
        F.when((strategy < 0) | (strategy >= STRATEGY_SLOTS), "bad strategy_id")
        .when(~action.isin("buy", "sell"), "bad action")
        .when(~side.isin("yes", "no"), "bad side")
        .when(~kind.isin("limit", "market"), "bad type")
        .when(count <= 0, "bad count")
        .when(limit & ((price < 1) | (price > 99)), "bad price")
        .when(F.coalesce(ticker, F.lit("")) == "", "empty ticker")
        .when(~ticker.rlike("^[A-Za-z0-9._-]+$"), "bad ticker char")
    )
