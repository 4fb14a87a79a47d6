"""Structured Streaming forms: each takes a streaming (or batch) DataFrame and returns one, so both can be compared."""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapewright.sources.scratch import place


def deduped(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Trades by trade_id, which carry no sequence number; the watermark bounds how long an id is remembered."""
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trade_id"])


def rates(events: DataFrame, window: str, key: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """Runs of events without a silence of `gap`."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


class InOrder(StatefulProcessor):
    """Steps through the rows of each key in the order of `nth`, the recorder's count of a row in its stream (from 1), however files and
    batches deal them out.

    A row whose number is the next one is stepped through at once and never stored; only rows that came before their turn wait
    in state, in blocks that are read again when the turn of their first row has come. If a number has not come when the watermark
    is `bound` past the earliest row that waits, it counts as lost, and the stream goes on behind it. A row that comes after
    that, or twice, is late: it is counted, and `late` says what comes out. State is read and written once for a key and batch."""

    FIELDS: tuple[str, ...] = ()  # of a row, beside nth, arrival and ts
    STATE = ""  # schema of the one value that is carried
    OUT: tuple[str, ...] = ()
    BLOCK = 4096  # rows that wait together
    bound_us = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id bigint", "rows string")
        self.progress = handle.getValueState("progress", f"next bigint, late bigint, made bigint, begun boolean, block_nth array<bigint>, block_id array<bigint>, block_us array<bigint>, {self.STATE}")

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        """The new state and the rows that come out. row: arrival, time in microseconds, FIELDS."""
        raise NotImplementedError

    def late(self, key: tuple, row: tuple, n: int) -> list[tuple]:
        """What comes out for a row behind its turn, the n-th such of its key."""
        return []

    def silent(self, key: tuple, state: tuple, now_us: int) -> tuple[tuple, list[tuple], int | None]:
        """As step, when the watermark is at now_us and nothing waits; and the time to be asked again."""
        return state, [], None

    def flush(self) -> None:
        """Called when a key has been worked through for this batch."""

    def _held(self, key: tuple) -> tuple | None:
        return self.progress.get()

    def _hold(self, key: tuple, progress: tuple) -> None:
        self.progress.update(progress)

    def _wake(self, key: tuple, ms: int) -> None:
        self.handle.registerTimer(ms)

    def _block(self, key: tuple, made: int) -> tuple:
        """Where a block of waiting rows lies in state."""
        return (made,)

    def _stored(self, key: tuple, rows: list[tuple], made: int) -> list[tuple[int, int, int]]:
        """Blocks of rows that wait: number and time of the first row around the block's id."""
        blocks = []
        for i in range(0, len(rows), self.BLOCK):
            made += 1
            self.waiting.updateValue(self._block(key, made), (json.dumps(rows[i : i + self.BLOCK]),))
            blocks.append((rows[i][0], made, rows[i][2]))
        return blocks

    def _taken(self, key: tuple, made: int) -> list[tuple]:
        block = self._block(key, made)
        rows = [tuple(r) for r in json.loads(self.waiting.getValue(block)[0])]
        self.waiting.removeKey(block)
        return rows

    def _advanced(self, key: tuple, rows: list[tuple], now: int) -> list[tuple]:
        """rows: nth, arrival, ts_us, FIELDS, in the order of nth."""
        due, late, made, begun, firsts, ids, since, *state = self._held(key) or (1, 0, 0, False, (), (), ())
        state = tuple(state) if begun else None
        blocks = sorted(zip(map(int, firsts), map(int, ids), map(int, since), strict=True))
        out: list[tuple] = []
        at, back, was = 0, 0, []  # was: rows of blocks that were read again, `back` of them done
        while True:
            while blocks and blocks[0][0] <= due:
                was, back = sorted(was[back:] + self._taken(key, blocks.pop(0)[1]), key=itemgetter(0)), 0
            end = blocks[0][0] if blocks else None
            while due != end:
                if back < len(was) and was[back][0] <= due:
                    nth, *row = was[back]
                    back += 1
                elif at < len(rows) and rows[at][0] <= due:
                    nth, *row = rows[at]
                    at += 1
                else:
                    break
                if nth == due:
                    state, more = self.step(key, state, tuple(row))
                    due += 1
                else:
                    late += 1
                    more = self.late(key, tuple(row), late)
                out += more
            if due == end:
                continue
            heads = [(r[0], 0, r[2]) for r in (*was[back : back + 1], *rows[at : at + 1])] + blocks[:1]
            if not heads:
                break
            first, _, waits = min(heads)
            if now < waits + self.bound_us:
                self._wake(key, (waits + self.bound_us) // 1000 + 1)
                break
            due = first
        ahead: list[tuple] = []
        for row in sorted(was[back:] + rows[at:], key=itemgetter(0)):
            if ahead and ahead[-1][0] == row[0]:
                late += 1
                out += self.late(key, row[1:], late)
            else:
                ahead.append(row)
        blocks += self._stored(key, ahead, made)
        if state is not None and not blocks:
            state, more, again = self.silent(key, state, now)
            out += more
            if again is not None:
                self._wake(key, again // 1000)
        self.flush()
        none = (None,) * len(self.STATE.split(","))
        made = max([made, *(b[1] for b in blocks)])
        self._hold(key, (due, late, made, state is not None, [b[0] for b in blocks], [b[1] for b in blocks], [b[2] for b in blocks], *(state or none)))
        return out

    def _given(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=list(self.OUT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["nth", "arrival", "ts_us", *self.FIELDS]
        given = [r for batch in rows for r in zip(*(batch[c].astype(object) for c in columns), strict=True)]
        given.sort(key=itemgetter(0))
        yield from self._given(key, self._advanced(key, given, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._given(key, self._advanced(key, [], timerValues.getCurrentWatermarkInMs() * 1000))

    def close(self) -> None:
        pass


class InOrderTogether(InOrder):
    """As InOrder, for streams of few rows each: neighbours share a key of the engine, whose state is read and written once a batch and
    which has one timer, so a batch costs no calls for each stream. The key of rows is `together`, and their stream is their first field."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stream bigint, id bigint", "rows string")
        self.held = handle.getValueState("held", "wake bigint, streams string")

    def _held(self, key):
        return self.streams[key[0]][1] if key[0] in self.streams else None

    def _hold(self, key, progress):
        self.streams[key[0]] = (self.woken.pop(key[0], None), progress)

    def _wake(self, key, ms):
        self.woken[key[0]] = ms

    def _block(self, key, made):
        return key[0] or 0, made  # a stream of no number has no neighbours

    def _all_advanced(self, given: dict[int | None, list[tuple]], now: int) -> Iterator[pd.DataFrame]:
        """Steps through the rows given of each stream, and through what is due by now of the others."""
        wake, text = self.held.get() or (None, "[]")
        self.streams: dict[int | None, tuple] = {k: (ms, progress) for k, ms, progress in json.loads(text)}
        self.woken: dict[int | None, int] = {}
        due = [k for k, (ms, _) in self.streams.items() if ms is not None and ms * 1000 <= now and k not in given]
        out = [(k, *x) for k in (*given, *due) for x in self._advanced((k,), sorted(given.get(k, ()), key=itemgetter(0)), now)]
        first = min((ms for ms, _ in self.streams.values() if ms is not None), default=None)
        if first is not None and (wake is None or first < wake or wake * 1000 <= now):
            wake = first
            self.handle.registerTimer(wake)
        self.held.update((wake, json.dumps([(k, *v) for k, v in self.streams.items()])))
        if out:
            yield pd.DataFrame(out, columns=list(self.OUT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given: dict[int | None, list[tuple]] = {}
        for batch in rows:
            for stream, *row in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in (self.FIELDS[0], "nth", "arrival", "ts_us", *self.FIELDS[1:])), strict=True):
                given.setdefault(stream, []).append(tuple(row))
        yield from self._all_advanced(given, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._all_advanced({}, timerValues.getCurrentWatermarkInMs() * 1000)


def _in_order(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, delay: str, bound_s: int) -> DataFrame:
    """delay: how far files may be behind each other in time; what comes later than that is dropped by the engine, which counts it."""
    processor.bound_us = bound_s * 1_000_000
    timed = rows.withColumn("ts_us", F.unix_micros("ts")).withWatermark("ts", delay)
    grouped = timed.select(*keys, "nth", "arrival", "ts", "ts_us", *processor.FIELDS).groupBy(*keys)
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


BOUND_S = 60  # that a stream waits for a number that has not come


class _Sequence(InOrder):
    FIELDS, STATE = ("seq",), "expected bigint"
    OUT = ("epoch", "sid", "arrival", "seq", "seq_class")

    def step(self, key, state, row):
        arrival, _, seq = row
        if state is None:
            return (seq,), [(arrival, seq, "First")]
        kind = "Ok" if seq == state[0] + 1 else "Stale" if seq <= state[0] else "Gap"
        return (max(state[0], seq),), [(arrival, seq, kind)]

    def late(self, key, row, n):
        return [(row[0], row[2], "Late")]


def sequence_monitor(frames: DataFrame, delay: str = "10 minutes", bound_s: int = BOUND_S) -> DataFrame:
    """Sequence class of each frame, from one number of state for each (epoch, sid); Late for one that came behind its turn.

    frames: epoch, sid, nth, arrival, ts, seq."""
    return _in_order(frames, ["epoch", "sid"], _Sequence(), "epoch int, sid bigint, arrival bigint, seq bigint, seq_class string", delay, bound_s)


class _Books(InOrder):
    """A gap in a stream invalidates all its books: a book is valid while the stream's count of gaps is that of its snapshot.

    Each market's book is a value of its own in state; a batch reads and writes those that its messages touch, once each."""

    FIELDS, STATE = ("seq", "kind", "ticker", "side", "price_cents", "qty"), "last bigint, gaps bigint"
    OUT = ("epoch", "sid", "arrival", "ticker", "valid", "levels")

    def init(self, handle):
        super().init(handle)
        self.books = handle.getMapState("books", "ticker string", "gaps bigint, keys array<string>, sizes array<bigint>")
        self.touched: dict[str, tuple[int, dict[str, int]]] = {}

    def flush(self):
        for ticker, (known, held) in self.touched.items():
            self.books.updateValue((ticker,), (known, list(held), list(held.values())))
        self.touched.clear()

    def book(self, ticker: str) -> tuple[int, dict[str, int]]:
        if ticker not in self.touched:
            known, names, sizes = self.books.getValue((ticker,)) if self.books.containsKey((ticker,)) else (-1, (), ())
            self.touched[ticker] = int(known), dict(zip(names, map(int, sizes), strict=True))
        return self.touched[ticker]

    def applied(self, state: tuple | None, row: tuple) -> tuple[tuple, bool, int, bool]:
        """The new count of gaps, whether the message's book is valid and its levels, and whether a snapshot must be asked for."""
        arrival, _, seq, kind, ticker, side, price, qty = row
        last, gaps = state or (None, 0)
        ahead, stale = last is not None and seq > last + 1, last is not None and seq <= last
        last, spoilt = seq if last is None else max(last, seq), False
        known, held = self.book(ticker)
        if kind == "snapshot":
            known, held = gaps, {f"{side}|{price}": int(qty)} if qty > 0 else {}
        elif ahead:
            gaps += 1
        elif kind == "delta" and not stale and known == gaps:
            level = f"{side}|{price}"
            size = held.get(level, 0) + int(qty)
            if size < 0:
                known, spoilt = -1, True
            elif size:
                held[level] = size
            else:
                held.pop(level, None)
        self.touched[ticker] = known, held
        return (last, gaps), known == gaps, len(held), spoilt or (ahead and kind != "snapshot")

    def step(self, key, state, row):
        state, valid, levels, _ = self.applied(state, row)
        return state, [(row[0], row[4], valid, levels)]


def book_monitor(frames: DataFrame, delay: str = "10 minutes", bound_s: int = BOUND_S) -> DataFrame:
    """Validity and number of levels of the message's market after each message."""
    return _in_order(frames, ["epoch", "sid"], _Books(), "epoch int, sid bigint, arrival bigint, ticker string, valid boolean, levels int", delay, bound_s)


TOGETHER = 8  # bits of a source's number that its neighbours may differ in


class _Heartbeat(InOrderTogether):
    FIELDS, STATE, OUT = ("source",), "seen bigint, health string", ("source", "at_us", "health")

    def __init__(self, lagging_us: int, stale_us: int):
        self.after = (("lagging", lagging_us), ("stale", stale_us))

    def _passed(self, seen: int, health: str, now: int) -> tuple[str, list[tuple]]:
        out = []
        for name, wait in self.after:
            if now - seen > wait and health != "stale" and health != name:
                health = name
                out.append((seen + wait, name))
        return health, out

    def step(self, key, state, row):
        ts = row[1]
        if state is None:
            return (ts, "ok"), [(ts, "ok")]
        health, out = self._passed(*state, ts)
        return (ts, "ok"), out + ([(ts, "ok")] if health != "ok" else [])

    def silent(self, key, state, now_us):
        seen = state[0]
        health, out = self._passed(*state, now_us)
        due = next((seen + wait + 1000 for name, wait in self.after if now_us - seen <= wait), None)
        return (seen, health), out, due


def heartbeat_monitor(events: DataFrame, lagging_s: int, stale_s: int, delay: str = "10 minutes", bound_s: int = BOUND_S) -> DataFrame:
    """When each source turns ok, lagging and stale: by the next event that shows the silence, or by a timer while it lasts.

    events: source, nth, arrival, ts."""
    processor = _Heartbeat(lagging_s * 1_000_000, stale_s * 1_000_000)
    near = events.withColumn("together", F.shiftright("source", TOGETHER))
    return _in_order(near, ["together"], processor, "source bigint, at_us bigint, health string", delay, bound_s)


class _Recovery(_Books):
    """One ladder for each stream: asked for by a gap or a spoilt book, ended by any snapshot of the stream, or climbed to its end."""

    STATE = "last bigint, gaps bigint, clock bigint, asked bigint, since bigint, more bigint"
    OUT = ("epoch", "sid", "asked", "rung", "recovered", "waited_us", "more")

    def __init__(self, rung_us: int, rungs: int):
        self.rung_us, self.rungs = rung_us, rungs

    def _expired(self, asked, since, more, now):
        if asked is not None and now >= since + self.rungs * self.rung_us:
            return [(asked, self.rungs, False, self.rungs * self.rung_us, more)]
        return []

    def step(self, key, state, row):
        last, gaps, clock, asked, since, more = state or (None, 0, 0, None, 0, 0)
        clock = max(clock, row[1])
        out = self._expired(asked, since, more, clock)
        if out:
            asked = None
        (last, gaps), _, _, ask = self.applied((last, gaps), row)
        if row[3] == "snapshot" and asked is not None:
            out.append((asked, (clock - since) // self.rung_us, True, clock - since, more))
            asked = None
        if ask and asked is None:
            asked, since, more = row[0], clock, 0
        elif ask:
            more += 1
        return (last, gaps, clock, asked, since, more), out

    def silent(self, key, state, now_us):
        last, gaps, clock, asked, since, more = state
        out = self._expired(asked, since, more, now_us)
        if out:
            asked = None
        due = None if asked is None else since + self.rungs * self.rung_us + 1000
        return (last, gaps, clock, asked, since, more), out, due


def recovery_monitor(frames: DataFrame, rung_s: int, rungs: int = 3, delay: str = "10 minutes", bound_s: int = BOUND_S) -> DataFrame:
    """Each episode of recovery of a stream when it ends: the arrival that asked for it, the rung it reached (`rungs` if the ladder ended
    without a snapshot, by a timer if nothing comes), how long it took, and how many more requests it took in."""
    schema = "epoch int, sid bigint, asked bigint, rung int, recovered boolean, waited_us bigint, more bigint"
    return _in_order(frames, ["epoch", "sid"], _Recovery(rung_s * 1_000_000, rungs), schema, delay, bound_s)


def drained(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its table. In complete mode the last result stands."""
    spark = df.sparkSession
    path = place(spark, name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # as processors need
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{path}/data").start()
    else:
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/data")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def source(df: DataFrame, name: str) -> DataFrame:
    """A stream over df, written as files to begin with."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with nth, the count of each row in its stream by arrival, as a recorder writes it beside a row."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("arrival")).cast("bigint"))


ROWS = 100_000  # of a file that is replayed


def replayed(df: DataFrame, by: str, name: str, files: int | None = None, a_batch: int = 8, last: DataFrame | None = None) -> DataFrame:
    """A stream over df in files dealt out by ranges of a column (of about ROWS rows each unless `files` says), read `a_batch` at a time:
    a batch has as many rows however long the log is.

    last: rows of a file that is written after the others, so it is read after them."""
    path = place(df.sparkSession, name)
    df.repartitionByRange(files or df.count() // ROWS + 1, by).write.parquet(path)
    if last is not None:
        last.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", a_batch).parquet(path)


def stream_of(spark: SparkSession, path: str, schema: str, a_batch: int = 1000) -> DataFrame:
    """A stream over a folder of NDJSON files. A file is read once, when it appears: rotate logs in small files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", a_batch).json(path)
