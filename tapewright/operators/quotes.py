"""Reference quotes around the last print."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.order import carried


def from_tape(tape: DataFrame, off: int) -> DataFrame:
    """Quotes without an inventory limit: ticker, side, tape_id of the placement, price, and the tape_id that replaces it.

    A quote is placed when its target price changes; a target out of range leaves the old quote resting.
    """
    both = tape.select("ticker", "tape_id", F.explode(F.array(F.struct(F.lit("ask").alias("side"), (F.col("price_cents") + off).alias("price_cents")), F.struct(F.lit("bid").alias("side"), (F.col("price_cents") - off).alias("price_cents")))).alias("q")).select("ticker", "tape_id", "q.*")
    p = F.col("price_cents")
    legal = both.where(F.when(F.col("side") == "ask", p.between(2, 99)).otherwise(p.between(1, 98)))
    by = Window.partitionBy("ticker", "side").orderBy("tape_id")
    placed = legal.withColumn("was", F.lag("price_cents").over(by)).where("was is null or was <> price_cents").drop("was")
    return placed.withColumn("until_tape_id", F.lead("tape_id").over(by))


def with_cap(tape: DataFrame, off: int, size: int, cap: int) -> DataFrame:
    """Each market's tape in order: quotes on both sides under an inventory cap, filled when prints go through them. Placement
    depends on the inventory that fills leave, so the state is carried from print to print."""

    def step(state, last, n, yes):
        bought, sold, placed, refused, ask, bid, ask_px, bid_px = state or (0, 0, 0, 0, None, None, -1, -1)
        if yes and ask and last > ask[0]:
            q = min(n, ask[1])
            sold += q
            ask = (ask[0], ask[1] - q) if ask[1] > q else None
        if not yes and bid and last < bid[0]:
            q = min(n, bid[1])
            bought += q
            bid = (bid[0], bid[1] - q) if bid[1] > q else None
        a, b = last + off, last - off
        if ask_px != a and 2 <= a <= 99:
            ask = None
            if sold - bought < cap:
                ask, ask_px, placed = (a, size), a, placed + 1
            else:
                refused += 1
        if bid_px != b and 1 <= b <= 98:
            bid = None
            if bought - sold < cap:
                bid, bid_px, placed = (b, size), b, placed + 1
            else:
                refused += 1
        return (bought, sold, placed, refused, ask, bid, ask_px, bid_px), (bought, sold, placed, refused)

    return carried(tape, ("ticker",), ("tape_id",), ("price_cents", "size", "taker_yes"), step, "ticker string, bought bigint, sold bigint, placed bigint, refused bigint", last=True)
