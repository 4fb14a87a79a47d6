"""Removal of long repeated byte strings by longest-previous-factor arrays, spread over tasks by content anchors.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. One suffix order of all positions would be
many times the input, so suffixes are put in order where equal ones can lie:

1. Anchors. Of the GRAM-byte strings in each window of LENGTH bytes the one of least hash is an anchor (the leftmost of
   equals), so equal windows hold the same anchor in the same place. Anchors are counted over all documents by their hash.
2. Each anchor that occurs again has a context, the bytes that windows around it can cover, known by a 128-bit digest. Equal
   contexts form a class: its copies repeat each other wholly. Classes that share an anchor with no other class are done.
3. The first context of each other class is fetched, and the classes of an anchor lie in one task. There the suffixes are put
   in lexicographic order to the depth of LENGTH bytes, by prefix tripling; in that order the previous and the next smaller
   position give each position's longest previous factor, the length of a common prefix of the bytes themselves. A position
   repeats if its factor reaches LENGTH or it is the source of one that does. Positions whose LENGTH bytes have a hash that no
   other of the task has cannot reach it and are left out before the order is made.
4. An anchor that more than SHARED_BY_MANY classes share is not one task's work: its windows are ordered by Spark, by a 128-bit
   digest and position, and dealt out by ranges of both, so that even one window that all of them hold is spread; a window's
   neighbours in that order are its previous and its next copy, and ends of tasks are matched afterwards.
5. Covered ranges are merged for each document and cut out. Documents without any are not shuffled.

With keep_first only later copies go: the longest previous factor alone decides, and all copies of a class but its first.

Null and empty texts have no bytes. Rows with equal doc_id are documents of their own. Matches never cross documents. Texts of
any length are worked through in pieces of PIECE bytes. Documents come before one another by file and place in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import U64, kept, mixed, on_files, placed, table, text_batches, utf8
from tapewright.llm.filters import key_filter, known, possibly, split_possibly

LENGTH = 200  # a multiple of 8
GRAM = 100
REACH = LENGTH - GRAM  # bytes before an anchor that a window can cover
PIECE = 1 << 18
BLOCK = 1 << 15
SHARED_BY_MANY = 512  # classes
TOGETHER = 1024  # contexts that a task works through at once, and what is left of an anchor's


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    x = a ^ (a >> U64(32))
    x *= U64(0x9FB21C651E98DF25)
    x += b
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    return x


def string_hashes(raw: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of the `length` bytes at each position, 64 bytes at least, from those of its halves."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        part = np.ascontiguousarray(raw[a : b + length - 1])
        h, size = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)) ^ U64(seed), 8
        while 2 * size <= length:
            h, size = _joined(h[:-size], h[size:]), 2 * size
        out[a:b] = mixed(_joined(h[: b - a], h[length - size : length - size + b - a]))
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each window of `width` lies; the leftmost of equals. len(h) - width + 1 windows."""
    n = len(h)
    key = (h & ~U64((1 << 24) - 1)) | np.arange(n, dtype=U64)
    m = -(-n // width) * width
    padded = np.full(m, ~U64(0))
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    i = np.arange(n - width + 1)
    return (np.minimum(behind[i], ahead[i + width - 1]) & U64((1 << 24) - 1)).astype(np.int64)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in raw and hashes of the anchors of all rows, in order. raw has fewer than 2**24 bytes."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = string_hashes(raw, GRAM)
    chosen = _least(h, REACH + 1)
    ok = np.zeros(len(chosen), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
    p = np.unique(chosen[ok])
    return p, h[p]


def _pieces(batches: Iterator[pa.RecordBatch], at: int):
    """(batch, first byte, raw, offsets, lead): small texts together, a long text in pieces that overlap.

    lead: None, or the bytes at the front of a piece that belong to the piece before it.
    """
    for b in text_batches(batches, at, PIECE // 2):
        raw, offsets = utf8(b.column(at))
        if len(raw) <= 2 * PIECE:
            yield b, 0, raw, offsets, None
            continue
        for r in range(b.num_rows):
            whole = raw[offsets[r] : offsets[r + 1]]
            for x in range(0, max(1, len(whole)), PIECE):
                lead = min(x, 2 * LENGTH)
                part = whole[x - lead : x + PIECE + 2 * LENGTH]
                yield b.slice(r, 1), x - lead, part, np.array([0, len(part)]), lead


def _own(p: np.ndarray, lead: int | None) -> np.ndarray:
    """Which anchors belong to their piece; the overlaps are wide enough for their windows and contexts."""
    return np.ones(len(p), bool) if lead is None else (p >= lead) & (p < lead + PIECE)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> the hashes of all anchors."""
    for _, _, raw, offsets, lead in _pieces(batches, 0):
        p, h = anchors(raw, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(h[_own(p, lead)].view(np.int64))], ["h"])


def _contexts(sent):
    """place, text -> place, position, anchor hash, digest of the context, bytes of context before the anchor, its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b, first, raw, offsets, lead in _pieces(batches, 1):
            p, h = anchors(raw, offsets)
            keep = known(held, h) & _own(p, lead)
            p, h = p[keep], h[keep]
            row = np.searchsorted(offsets, p, "right") - 1
            s, e = np.maximum(p - REACH, offsets[row]), np.minimum(p + LENGTH, offsets[row + 1])
            whole = memoryview(np.ascontiguousarray(raw))
            left = (p - s).astype(np.int32)
            c = [hashlib.blake2b(whole[x:y], digest_size=16, salt=z.to_bytes(2, "little")).digest() for x, y, z in zip(s.tolist(), e.tolist(), left.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(row)), pa.array(p - offsets[row] + first), pa.array(h.view(np.int64)), pa.array(c, pa.binary()), pa.array(left), pa.array((e - s).astype(np.int32)),
            ], ["place", "pos", "h", "c", "left", "size"])

    return run


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, place, wanted (class, h, members, start, left, size) -> class, h, members, place, start, left, context."""
    for b in text_batches(batches, 0):
        raw, offsets = utf8(b.column(0))
        lists = b.column(2)
        row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
        w = lists.flatten()
        start, size = (np.asarray(w.field(i)).astype(np.int64) for i in (3, 5))
        at = offsets[row] + start
        whole = raw.tobytes()
        ctx = [whole[x:y] for x, y in zip(at.tolist(), (at + size).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([w.field(0), w.field(1), w.field(2), b.column(1).take(pa.array(row)), w.field(3), w.field(4), pa.array(ctx, pa.binary())], ["class", "h", "members", "place", "start", "left", "context"])


def _ranked(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(x)
    s = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]) if len(x) else s
    return out


class Suffixes:
    """Ranks of the strings of 8, 24, 72, ... bytes at each position of a buffer: each level ranks triples of the one before."""

    def __init__(self, raw: np.ndarray, depth: int = LENGTH):
        self.depth, n = depth, len(raw)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.first = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(U64)  # order of numbers is order of bytes
        self.levels = [(8, _ranked(self.first))]
        while 3 * self.levels[-1][0] <= depth:
            size = self.levels[-1][0]
            self.levels.append((3 * size, self._ranked(np.arange(n), (0, size, 2 * size))))

    def _ranked(self, at: np.ndarray, shifts: tuple[int, ...]) -> np.ndarray:
        """The ranks of the places `at` by the last level's ranks at these distances behind them."""
        r, n = self.levels[-1][1], len(self.first)
        key, top = np.zeros(len(at), np.int64), 1
        for shift in shifts:
            if top * (n + 1) >= 1 << 62:
                key, top = _ranked(key), n + 1
            i = at + shift
            key = key * (n + 1) + np.where(i < n, r[np.minimum(i, n - 1)] + 1, 0)
            top *= n + 1
        return _ranked(key)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ranks of the depth bytes at each of the places. The last part may overlap the one before it."""
        size = self.levels[-1][0]
        return self._ranked(at, tuple(min(x, self.depth - size) for x in range(0, self.depth, size)))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix at positions x and y, at most depth; depth bytes must follow both."""
        out = np.zeros(len(x), np.int64)
        for size, r in reversed(self.levels):
            for _ in range(2):
                fits = out + size <= self.depth
                out[fits] += size * (r[x[fits] + out[fits]] == r[y[fits] + out[fits]])
        rest = out < self.depth
        differs = self.first[x[rest] + out[rest]] ^ self.first[y[rest] + out[rest]]
        out[rest] += sum((differs < U64(1 << 64 - 8 * k)).astype(np.int64) for k in range(1, 8))
        return out


def nearest_smaller(p: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, or -1. All places follow each other's pointers at once."""
    prev = np.arange(-1, len(p) - 1)
    todo = np.arange(1, len(p))
    while len(todo):
        todo = todo[p[prev[todo]] >= p[todo]]
        prev[todo] = prev[prev[todo]]
        todo = todo[prev[todo] >= 0]
    return prev


def longest_previous(s: Suffixes, at: np.ndarray, position: np.ndarray, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor at each of the places `at`, at most depth bytes, and which places are sources of one of depth bytes.

    position: where each place lies in the corpus; places with the same one are the same text and no copies of each other.
    Unless exact, factors shorter than depth bytes are given as 0."""
    rank = s.rank(at)
    order = np.argsort(rank)  # the order of equal strings does not matter
    x, p, rank = at[order], position[order], rank[order]
    before, behind = nearest_smaller(p), len(p) - 1 - nearest_smaller(p[::-1])[::-1]
    factor, source = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    for near, ok in ((before, before >= 0), (behind, behind < len(p))):
        i = np.flatnonzero(ok)
        full = rank[i] == rank[near[i]]
        source[near[i[full]]] = True
        factor[i[full]] = s.depth
        if exact:
            i = i[~full]
            factor[i] = np.maximum(factor[i], s.common(x[i], x[near[i]]))
    out = np.empty(len(at), np.int64), np.empty(len(at), bool)
    out[0][order], out[1][order] = factor, source
    return out


def _shared(h: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _windows(contexts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all contexts, and for each window of LENGTH bytes its place in them, its context and its offset in that."""
    raw, offsets = utf8(contexts)
    n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return raw, offsets[of] + off, of, off


def _solved(keep_first: bool):
    """class, h, members, place, start, left, context -> class, lo, hi: the part of each context that repeated windows cover."""

    def solve(t: pa.RecordBatch) -> pa.RecordBatch:
        raw, at, of, off = _windows(t.column(6))
        again = _shared(string_hashes(raw, LENGTH)[at]) if len(at) else np.zeros(0, bool)
        at, of, off = at[again], of[again], off[again]
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], ["class", "lo", "hi"])
        # Only the bytes that these windows cover are put in order.
        used = np.zeros(len(raw) + 1, np.int32)
        np.add.at(used, at, 1)
        np.add.at(used, at + LENGTH, -1)
        used = np.cumsum(used[:-1]) > 0
        place = np.cumsum(used) - 1
        file, row = (np.asarray(t.column(3).field(i)) for i in (0, 1))
        _, doc = np.unique(np.stack([file, row], axis=1), axis=0, return_inverse=True)
        position = doc.ravel().astype(np.int64)[of] << 34 | np.asarray(t.column(4)).astype(np.int64)[of] + off
        factor, source = longest_previous(Suffixes(raw[used]), place[at], position, False)
        hit = factor >= LENGTH if keep_first else (factor >= LENGTH) | source
        of, off = of[hit], off[hit]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        lo, hi = (np.minimum.reduceat(off, first), np.maximum.reduceat(off, first) + LENGTH) if len(of) else (off, off)
        return pa.RecordBatch.from_arrays([t.column(0).take(pa.array(of[first])), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["class", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Solves rows sorted by h some groups at a time, cut where a group ends."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for whole in batches:
            for x in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(x, TOGETHER)
                if rows >= TOGETHER:
                    other = np.asarray(b.column(1)) != held[-1].column(1)[-1].as_py()
                    if other.any():
                        cut = int(np.argmax(other))
                        yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0])
                        held, rows, b = [], 0, b.slice(cut)
                held.append(b)
                rows += b.num_rows
        if rows:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, h, members, place, start, left, context -> a row for each window: digest (k1, k2), class, offset.

    Equal windows have the anchor in the same place, and one window can lie in the contexts of two anchors: the digest is of the
    anchor and its place too, so no window is its own copy."""
    for b in batches:
        for x in range(0, b.num_rows, TOGETHER):
            part = b.slice(x, TOGETHER)
            raw, at, of, off = _windows(part.column(6))
            h = np.asarray(part.column(1)).view(np.uint64)[of]
            rel = (LENGTH + np.asarray(part.column(5)).astype(np.int64)[of] - off).astype(U64)
            keys = [mixed(string_hashes(raw, LENGTH, seed)[at] + mixed(h + rel + U64(seed))).view(np.int64) if len(at) else np.zeros(0, np.int64) for seed in (0x51ED270B, 0x2F72B421)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), part.column(0).take(pa.array(of)), pa.array(off.astype(np.int32))], ["k1", "k2", "class", "off"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of k1, k2 and position -> those that equal the row before or behind them, and the ends of the task."""
    held, known_earlier, first = None, False, True

    def marked(t: pa.RecordBatch, earlier: np.ndarray, later: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        i = np.flatnonzero(earlier | later | edge)
        rows = t.take(pa.array(i))
        flags = (pa.array(x[i]) for x in (earlier, later, edge))
        return pa.RecordBatch.from_arrays([*rows.columns, *flags], [*rows.schema.names, "earlier", "later", "edge"])

    for b in batches:
        if not b.num_rows:
            continue
        t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        k1, k2 = np.asarray(t.column(0)), np.asarray(t.column(1))
        same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        earlier, n = np.concatenate([[known_earlier], same]), t.num_rows - 1
        if n:
            yield marked(t.slice(0, n), earlier[:n], same, (np.arange(n) == 0) & first)
            first = False
        held, known_earlier = t.slice(n), bool(earlier[n])  # the last row waits for what follows it
    if held is not None:
        yield marked(held, np.array([known_earlier]), np.array([False]), np.array([True]))


def covered(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """place, start, end: byte ranges, which may overlap, whose union is what is repeated."""
    rows = placed(on_files(docs))
    place = rows.schema["place"].dataType.simpleString()
    spark, n = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("doc.text").alias("text")
    counted = rows.select(text).mapInArrow(_hashes, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = spark.sparkContext.broadcast(key_filter(kept(counted.select("h"), "anchors")))
    found = kept(rows.select("place", text).mapInArrow(_contexts(again), f"place {place}, pos bigint, h bigint, c binary, left int, size int"), "contexts", "zstd")
    first = F.struct("place", "pos", "left")
    classes = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.first("size").alias("size"))
    classes = classes if not keep_first else classes.repartitionByRange(n, "first").sortWithinPartitions("first")  # numbered in the order of places
    classes = kept(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    shared = kept(classes.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min("copies").alias("fewest")).where("members > 1"), "shared")
    if not keep_first:
        shared = shared.where("fewest = 1")  # where all have copies, all is known
    start = (F.col("first.pos") - F.col("first.left")).alias("start")
    wanted = classes.where(F.col("size") >= LENGTH).join(shared, "h").select(F.col("first.place").alias("p"), F.struct("class", "h", "members", start, F.col("first.left").alias("left"), "size").alias("w"))
    wanted = kept(wanted.groupBy("p").agg(F.collect_list("w").alias("wanted")), "wanted")  # a list is as long as its document
    some = possibly(rows.select("place", text), key_filter(wanted.select(F.xxhash64("p"))), F.xxhash64("place")).join(wanted, F.col("place") == F.col("p"))
    texts = kept(some.select("text", "place", "wanted").mapInArrow(_fetched, f"class bigint, h bigint, members bigint, place {place}, start bigint, left int, context binary"), "class_contexts", "zstd")
    few = texts.where(F.col("members") <= SHARED_BY_MANY).repartition(n, "h").sortWithinPartitions("h").mapInArrow(_solved(keep_first), "class bigint, lo int, hi int")
    dealt = kept(texts.where(F.col("members") > SHARED_BY_MANY).mapInArrow(_dealt, "k1 bigint, k2 bigint, class bigint, off int"), "windows")
    order = ("k1", "k2", "class")
    marked = kept(dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, "k1 bigint, k2 bigint, class bigint, off int, earlier boolean, later boolean, edge boolean"), "neighbours")
    ends = Window.partitionBy("k1", "k2").orderBy("class")  # two rows a task at most
    edges = marked.where("edge").select("class", "off", (F.col("earlier") | (F.row_number().over(ends) > 1)).alias("earlier"), (F.col("later") | F.lead("off").over(ends).isNotNull()).alias("later"))
    many = marked.where("not edge").select("class", "off", "earlier", "later").union(edges).where("earlier" if keep_first else "earlier or later")
    many = many.groupBy("class").agg(F.min("off").alias("lo"), (F.max("off") + LENGTH).alias("hi"))
    whole = (F.col("copies") > 1) & (F.col("size") >= LENGTH)
    parts = classes.join(few.unionByName(many), "class", "left").where(whole | F.col("lo").isNotNull()).select("h", "c", "first", whole.alias("whole"), "lo", "hi")
    own = found.join(kept(parts, "class_ranges"), ["h", "c"])
    if keep_first:
        own = own.withColumn("whole", F.col("whole") & (first != F.col("first")))
    lo, hi = F.when(F.col("whole"), 0).otherwise(F.col("lo")), F.when(F.col("whole"), F.col("size")).otherwise(F.col("hi"))
    start = F.col("pos") - F.col("left")
    return own.select("place", (start + lo).alias("start"), (start + hi).alias("end")).where("start is not null")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as disjoint, not adjacent ones."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:], [len(s)]]) - 1] if len(s) else e


def _cut(text: bool):
    """doc, text, ranges -> doc, the digest of what stays, and, if `text`, what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for t, ranges in zip(b.column(1), b.column(2), strict=True):
                raw = (t.as_py() or "").encode()
                r = ranges.values.flatten() if ranges.is_valid else None
                s, e = merged(*(np.asarray(x) for x in r)) if r else (np.zeros(0, np.int64),) * 2
                left = [raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)]
                h = hashlib.sha256()
                for part in left:
                    h.update(part)
                for o, v in zip(out, (len(raw), int((e - s).sum()), len(s), h.hexdigest(), b"".join(left) if text else None), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "left"])

    return run


def removed(docs: DataFrame, keep_first: bool = True, text: bool = True) -> DataFrame:
    """For each row of docs: doc (its columns), n_bytes, n_removed, n_spans, kept_sha256, and `left`, the bytes that stay.

    Cuts may fall inside a character, so what stays is bytes. Without `text`, left is null."""
    docs = on_files(docs)
    ranges = covered(docs, keep_first).groupBy("place").agg(F.collect_list(F.struct("start", "end")).alias("ranges")).select(F.col("place").alias("p"), "ranges")
    ranges = kept(ranges, "ranges")
    hit, clear = split_possibly(placed(docs), key_filter(ranges.select(F.xxhash64("p"))), F.xxhash64("place"))
    schema = f"doc {placed(docs).schema['doc'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, left binary"
    none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>").alias("ranges")
    body = F.col("doc.text").alias("body")
    found = hit.join(ranges, F.col("place") == F.col("p"), "left").select("doc", body, "ranges").unionByName(clear.select("doc", body, none))
    return found.mapInArrow(_cut(text), schema)


def digests(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(docs.select("doc_id", "text"), keep_first, False).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERY = "op7_repeats"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
