"""Request logs, latency stamps, rate limits and latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import requests as rq
from tapewright.operators.order import carried
from tapewright.operators.slices import over


def template_regex(path: str) -> str:
    """A cost template as a regular expression: :x and {x} are one segment, *x is all the rest."""
    out = []
    for seg in filter(None, path.split("/")):
        if seg.startswith("*"):
            return "^/+" + "/+".join([*out, ".*[^/].*"]) + "$"
        out.append("[^/]+" if seg.startswith(":") or (seg.startswith("{") and seg.endswith("}")) else "".join("\\" + c if c in ".+?()[]{}|^$\\" else c for c in seg))
    return "^/+" + "/+".join(out) + "/*$"


def costs(requests: DataFrame, table: list[tuple[str, str, int]], default: int = rq.DEFAULT_COST) -> DataFrame:
    """requests (method, wire_path) with their cost: an exact entry first, then the first template that matches, else the default.

    The table is a file of a few entries, so it is one expression and no join."""
    cost = F.lit(None).cast("int")
    for method, path, value in reversed(table):
        cost = F.when((F.col("method") == method) & F.col("wire_path").rlike(template_regex(path)), value).otherwise(cost)
    for method, path, value in reversed(table):
        cost = F.when((F.col("method") == method) & (F.col("wire_path") == path), value).otherwise(cost)
    return requests.withColumn("cost", F.coalesce(cost, F.lit(default)))


def token_bucket(requests: DataFrame, rate: int, capacity: int, max_wait_ns: int) -> DataFrame:
    """Replays the milli-token bucket of each (account, bucket): refills exactly (the remainder is carried), starts full, may go into
    debt within the longest wait. Each grant depends on all before it."""
    if rate <= 0 or capacity <= 0:
        raise ValueError("a bucket needs a rate and a capacity above 0")
    full = capacity * 1000

    def step(state, req_id, now, cost):
        tokens, carry, last = state or (full, 0, None)
        if last is not None and tokens < full:
            earned = (now - last) * rate * 1000 + carry
            tokens, carry = tokens + earned // 10**9, earned % 10**9
            if tokens >= full:
                tokens, carry = full, 0
        need, before = cost * 1000, tokens
        short = need - tokens
        wait = 0 if short <= 0 else -(-(short * 10**9 - carry) // (rate * 1000))
        granted = wait <= max_wait_ns
        if granted:
            tokens -= need
        return (tokens, carry, now), (req_id, granted, wait if granted else 0, before, tokens)

    return carried(requests, ("account", "bucket"), ("now_ns", "req_id"), ("req_id", "now_ns", "cost"), step, "account bigint, bucket string, req_id bigint, granted boolean, wait_ns bigint, before bigint, after bigint")


def latest(rows: DataFrame, key: str, by: str, *columns: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), by).alias("s")).select(key, "s.*")


def merged_state(rows: DataFrame, key: str, by: str, *columns: str) -> DataFrame:
    """The newest value of each field of each key that is there: later rows that lack a field leave it as it was."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by))).alias(c) for c in columns))


def telemetry(requests: DataFrame) -> DataFrame:
    """Requests, tokens and refusals by outcome, bucket and path; ids in paths are folded."""
    outcome = F.when(F.col("transport_error"), "transport").when(F.col("http_status") >= 400, "error").otherwise("ok")
    path = F.regexp_replace("wire_path", "[0-9]+", ":id")
    return requests.groupBy(outcome.alias("outcome"), "bucket", path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tokens"), F.count_if(F.col("http_status") == 429).alias("drift"))


def order_rate(ts: str, key: str, seconds: int) -> Column:
    by = Window.partitionBy(key).orderBy(F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")).rangeBetween(-seconds, 0)
    return F.count(F.lit(1)).over(by)


def class_rollup(rows: DataFrame, record: tuple[str, ...], cls: str, blockers: dict[str, Column]) -> DataFrame:
    """Records (rows of one `record` and `cls`) by class, former class and blockers. Any blocker of any row makes a record BLOCKED;
    it keeps the class it is blocked from and the sorted distinct set of its blockers (a fixed few kinds)."""
    flags = rows.groupBy(*record, cls).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"is_{k}") for k, c in blockers.items()))
    held = flags.select(F.col(cls).alias("was"), F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"is_{k}"), F.lit(k)) for k in blockers)))).alias("blockers"))
    blocked = F.size("blockers") > 0
    return held.groupBy(F.when(blocked, "BLOCKED").otherwise(F.col("was")).alias("class"), F.when(blocked, F.col("was")).otherwise("").alias("blocked_from"), "blockers").agg(F.count(F.lit(1)).alias("n"))


def tallied(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def orders_by_hour(requests: DataFrame) -> DataFrame:
    return requests.where("method <> 'GET'").groupBy(F.date_trunc("hour", "ts").cast("string").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def status_tally(requests: DataFrame) -> DataFrame:
    return requests.groupBy("http_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("method") == "GET").alias("reads"))


def call_cost(requests: DataFrame, tokens: int) -> DataFrame:
    """What a call seems to cost: tokens earned in the hours with calls over the calls that went through."""
    hours = requests.groupBy("method", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("http_status") == 200).alias("fine"))
    return hours.groupBy("method").agg(F.sum("calls").alias("calls"), F.round(tokens * F.count(F.lit(1)) / F.sum("fine"), 6).alias("inferred_cost"))


def top_blockers(requests: DataFrame, most: int) -> DataFrame:
    """The commonest kinds of failed call: a report of fixed length."""
    failed = requests.where((F.col("http_status") != 200) | F.col("transport_error"))
    return tallied(failed.withColumn("blocker", F.concat_ws(" ", "method", F.col("http_status").cast("string"))), "blocker").orderBy(F.desc("n"), "blocker").limit(most)


def gates_and_modes(requests: DataFrame, ttl: dict[str, int], most_s: int, modes: tuple[str, ...]) -> DataFrame:
    """Orders by the first gate that stops them and by mode.

    An order's age is the time since its account's row before it, on which it acts. ttl: seconds by method, 0 or none for no bound; most_s: seconds
    that any order may have waited. The ttl comes first. Accounts are dealt out over the modes."""
    x = over(requests, ("account",), ("ts", "req_id"), before={"seen": F.col("ts")})
    age = F.expr("timestampdiff(MICROSECOND, seen, ts)")
    own = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in ttl.items() for v in kv)), F.col("method")), F.lit(0)).cast("bigint")
    gate = F.when((own != 0) & (age > own * 1_000_000), "expired_ttl").when(age > most_s * 1_000_000, "expired_queue").otherwise("sent")
    mode = F.element_at(F.array(*map(F.lit, modes)), (F.col("account") % len(modes) + 1).cast("int"))
    return tallied(x.select(gate.alias("gate"), mode.alias("mode")), "gate", "mode")


def recent(requests: DataFrame, word: str, most: int) -> DataFrame:
    """The newest requests that hold a word: the log view's fixed length."""
    return requests.where(F.contains(F.lower(F.concat("method", "path")), F.lit(word))).orderBy(F.desc("req_id")).limit(most).select("req_id", "method", "http_status")


def retained(requests: DataFrame, most: int) -> DataFrame:
    """The newest rows of each account: what a bounded history keeps."""
    k = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("req_id")))
    return requests.withColumn("k", k).where(F.col("k") <= most).select("account", "req_id")


def _payoff() -> Column:
    return F.col("size") * (F.when(F.col("yes_wins"), 100).otherwise(0) - F.col("price_cents"))


def win_loss(settled: DataFrame, width: int) -> DataFrame:
    band = F.floor(F.col("price_cents") / width).cast("int").alias("band")
    return settled.groupBy("ticker", band).agg(F.count_if("yes_wins").alias("wins"), F.count(F.lit(1)).alias("n"), F.sum(_payoff()).alias("pnl_cents"))


def win_loss_by_close(settled: DataFrame, days: int) -> DataFrame:
    """Wins, rows and payoff by the time from a print to its market's last one, in bands of `days` days."""
    close = settled.groupBy("ticker").agg(F.max("ts").alias("close_ts"))
    band = F.floor(F.datediff("close_ts", "ts") / days).cast("int").alias("band")
    x = settled.join(close, "ticker")
    return x.groupBy(band).agg(F.count_if("yes_wins").alias("wins"), F.count(F.lit(1)).alias("n"), F.round(F.count_if("yes_wins") / F.count(F.lit(1)), 6).alias("rate"), F.sum(_payoff()).alias("pnl_cents"))


def positions(tape: DataFrame, settles: DataFrame) -> DataFrame:
    """By book (family), over its markets without a settlement: how many, contracts held, their cost, and what they would gain at the last price."""
    held = tape.join(settles, "ticker", "left_anti").groupBy("family", "ticker").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("price_cents")).alias("cost"), F.max_by("price_cents", "tape_id").alias("mark"))
    return held.groupBy(F.col("family").alias("book")).agg(F.count(F.lit(1)).alias("open_markets"), F.sum("n").alias("contracts"), F.sum("cost").alias("collateral_cents"), F.sum(F.col("n") * F.col("mark") - F.col("cost")).alias("floating_cents"))


def books(settled: DataFrame) -> DataFrame:
    """Markets, result, wins and losses of each book, from one row for each of its markets."""
    m = settled.groupBy("family", "ticker").agg(F.sum(_payoff()).alias("pnl"), F.count_if("yes_wins").alias("wins"), F.count_if(~F.col("yes_wins")).alias("losses"))
    return m.groupBy(F.col("family").alias("book")).agg(F.count(F.lit(1)).alias("markets"), F.sum("pnl").alias("realized_cents"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


def daily_edge(settled: DataFrame, small: int) -> DataFrame:
    """Profit of each day from small gains, from large losses, and in all."""
    pnl = _payoff()
    return settled.groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.sum(F.when(pnl.between(0, small), pnl).otherwise(0)).alias("freq_edge"), F.sum(F.when(pnl < -small, pnl).otherwise(0)).alias("mag_edge"), F.sum(pnl).alias("net"),
    )


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many keys of the left are missing on the right, and how many there are extra."""
    k = left.columns[0]
    sides = left.distinct().withColumn("l", F.lit(1)).join(right.distinct().withColumn("r", F.lit(1)), k, "full_outer")
    n = sides.agg(F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"))
    return n.unpivot([], ["missing", "extra"], "side", "n")


def kind_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "yes").alias("yes_side"))
