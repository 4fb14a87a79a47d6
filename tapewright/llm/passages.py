"""Removal of repeated passages of words by a compacted de Bruijn graph.

The edges of the graph are the windows of 35 (Shape.window) consecutive words of one document; a window that starts anywhere else too is a
repeated edge, and every word it covers goes. Windows are judged on the input, not on what is left.

1. Edges travel in bundles. Of the 12-word strings (Shape.gram) of a window the one of least hash is its anchor (the leftmost of equals);
   consecutive windows with one anchor are a bundle, whose text is one string of words. Equal windows have equal anchors in
   the same place, so bundles of an anchor that occurs once are left out before anything is shuffled but its hash.
2. Bundles of equal text (a 128-bit BLAKE2 digest of the words) are one class; if it has copies, all its edges are repeated.
   Where several classes share an anchor - the graph branches there - the edges of each class, once a class, are counted by a
   digest of their own words; their repeated runs are segments, as classes with copies are.
3. Compaction. A segment that follows another in some document is linked to it. Links that are the only way out of one
   segment and the only way into the next join them; joins that double their reach turn such paths into one, with each
   segment's offset in it (a cycle is cut before its least segment).
4. Occurrences of a path that go on in it become one span of a document.
5. Verification. The words of each path are fetched from the coordinates of its segments' first copies, in blocks of 64
   words, and every span is compared with them word by word; only words that agree go.

Words: runs of other than blank, tab, line feed, vertical tab, form feed, carriage return, unchanged. Null and empty texts have
none. Rows with equal doc_id are documents of their own. A text of any length is one row of a task, with about 12 bytes held
for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import U64, kept, on_files, placed, runs, shingled, table, text_batches, utf8, word_hashes
from tapewright.llm.filters import key_filter, known, possibly, split_possibly
from tapewright.llm.repeats import _least



class Shape(NamedTuple):
    window: int = 35  # words
    gram: int = 12  # words of an anchor
    block: int = 64  # words of a path that are compared at once


SHAPE = Shape()
STRETCH = 1 << 20  # windows whose anchors are chosen at once

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


class Words:
    """The words of some texts: their places in `joined`, where one blank follows each, and the bounds of each text in them."""

    def __init__(self, column: pa.Array):
        raw, offsets = utf8(column)
        self.starts, self.ends = runs(_WORD[raw], offsets)
        self.bounds = np.searchsorted(self.starts, offsets)
        self._raw = raw

    def hashes(self) -> np.ndarray:
        return word_hashes(self._raw, self.starts, self.ends, 11)

    def join(self) -> tuple[memoryview, np.ndarray]:
        """All words, each with a blank behind it, and where each begins, with the end."""
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        mask = np.ones(len(out), bool)
        mask[at[1:] - 1] = False
        out[mask] = self._raw[_WORD[self._raw]]
        return memoryview(out), at


def bundles(words: Words, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window and number of windows of each bundle, and its anchor's hash. Windows are numbered by their first word."""
    n = len(words.starts)
    none = np.zeros(0, np.int64)
    if n < shape.window:
        return none, none, none, np.zeros(0, U64)
    h = shingled(words.hashes(), np.array([0, n]), shape.gram)[0]
    ok = np.zeros(n - shape.window + 1, bool)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= shape.window:
            ok[a : b - shape.window + 1] = True
    width = shape.window - shape.gram + 1
    chosen = np.empty(len(ok), np.int64)
    for a in range(0, len(ok), STRETCH):
        chosen[a : a + STRETCH] = a + _least(h[a : a + STRETCH + width - 1], width)
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, np.zeros(0, U64)
    p = chosen[at]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    start = at[first]
    return np.searchsorted(words.bounds, start, "right") - 1, start, np.diff(np.append(first, len(at))), h[p[first]]


def _hashes(shape: Shape):
    """text -> the hash of each bundle's anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 0):
            h = bundles(Words(b.column(0)), shape)[3]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


def _digests(whole: memoryview, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([hashlib.blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def _bundled(sent, shape: Shape):
    """place, text -> place, start (word), windows, anchor's hash and digest of each bundle whose anchor may occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            words = Words(b.column(1))
            row, start, n, h = bundles(words, shape)
            keep = known(sent.value, h)
            row, start, n, h = row[keep], start[keep], n[keep], h[keep]
            whole, at = words.join()
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(row)), pa.array(start - words.bounds[row]), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)),
                _digests(whole, at[start], at[start + n + shape.window - 1]),
            ], ["place", "start", "n", "h", "c"])

    return run


def _wanted_rows(b: pa.RecordBatch) -> tuple[Words, np.ndarray, pa.StructArray]:
    """The words of a batch (text, wanted), and for each wanted struct (whose first field is a start) its first word and fields."""
    words, lists = Words(b.column(0)), b.column(1)
    row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
    w = lists.flatten()
    return words, words.bounds[row] + np.asarray(w.field(0)).astype(np.int64), w


def _edges(shape: Shape):
    """text, wanted (start, n, class) -> class, place in it and digest of each edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 0):
            words, start, w = _wanted_rows(b)
            n = np.asarray(w.field(1)).astype(np.int64)
            whole, at = words.join()
            off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first = np.repeat(start, n) + off
            yield pa.RecordBatch.from_arrays([w.field(2).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(off.astype(np.int32)), _digests(whole, at[first], at[first + shape.window])], ["class", "off", "k"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, wanted (start, n, path, block, inner) -> path, block, inner and the n words, joined by one blank."""
    for b in text_batches(batches, 0):
        words, start, w = _wanted_rows(b)
        whole, at = words.join()
        ends = start + np.asarray(w.field(1)).astype(np.int64)
        text = [str(whole[x : y - 1], "utf-8") for x, y in zip(at[start].tolist(), at[ends].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([w.field(2), w.field(3), w.field(4), pa.array(text, pa.string())], ["path", "block", "inner", "words"])


def _fetched(rows: DataFrame, wanted: DataFrame, run, schema: str) -> DataFrame:
    """What `run` makes of the texts that are wanted; wanted: p (a place), w (a struct). A document's list is as long as it is."""
    wanted = kept(wanted.groupBy("p").agg(F.collect_list("w").alias("wanted")), "wanted")
    some = possibly(rows, key_filter(wanted.select(F.xxhash64("p"))), F.xxhash64("place")).join(wanted, F.col("place") == F.col("p"))
    return some.select("text", "wanted").mapInArrow(run, schema)


def _reached(state: DataFrame) -> DataFrame:
    """node, to, off (the words between them), low, head -> the same once no pointer moves: to is the head of each path.

    Rows that are still not at a head at the end are on cycles; low is then the least node of theirs."""
    state = kept(state, "path")
    open_before = None
    while True:
        seen = Observation()
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("off").alias("off2"), F.col("low").alias("low2"), F.col("head").alias("head2"))
        step = state.where("not head").join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("off") + F.col("off2")).alias("off"), F.least("low", "low2").alias("low"), F.col("head2").alias("head"), (F.col("low2") < F.col("low")).alias("fell"))
        step = step.unionByName(state.where("head").withColumn("fell", F.lit(False)))
        state = kept(step.observe(seen, F.count_if(~F.col("head")).alias("open"), F.count_if("fell").alias("fell")), "path").drop("fell")
        if not seen.get["open"] or (seen.get["open"] == open_before and not seen.get["fell"]):
            return state
        open_before = seen.get["open"]


def compacted(links: DataFrame) -> DataFrame:
    """a, b, m (words from a to b; distinct pairs) -> node, path, at: nodes joined into paths where nothing branches.

    A link joins if it is the only one from a and the only one to b. Nodes without such links do not appear."""
    ways_out = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"), F.min("m").alias("m")).where("n = 1")
    ways_in = links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    only = kept(ways_out.select("a", "b", "m").join(ways_in.select("b"), "b"), "joined")
    self = F.col("node").alias("to"), F.lit(0).cast("bigint").alias("off"), F.col("node").alias("low"), F.lit(True).alias("head")
    heads = only.select(F.col("a").alias("node")).join(only.select(F.col("b").alias("node")), "node", "left_anti").select("node", *self)
    rest = only.select(F.col("b").alias("node"), F.col("a").alias("to"), F.col("m").alias("off"), F.col("b").alias("low"), F.lit(False).alias("head"))
    found = _reached(heads.union(rest))
    done = found.where("head")
    cycles = kept(found.where("not head").select("node", "low"), "cycles")
    if not cycles.isEmpty():
        cut = cycles.where("node = low").select("node", *self)
        on = only.join(cycles.where("node <> low").select(F.col("node").alias("b")), "b")
        on = on.select(F.col("b").alias("node"), F.col("a").alias("to"), F.col("m").alias("off"), F.col("b").alias("low"), F.lit(False).alias("head"))
        done = done.union(_reached(cut.union(on)))
    return done.select("node", F.col("to").alias("path"), F.col("off").alias("at"))


def _pieces(df: DataFrame, block: int) -> DataFrame:
    """df (path, at, size, word) cut where blocks of its path end: path, block, inner, word, n."""
    cut = df.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    first = F.greatest(F.col("at"), F.col("block") * block)
    last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("p", "path", "block", (first - F.col("block") * block).alias("inner"), (F.col("word") + first - F.col("at")).alias("word"), (last - first).cast("int").alias("n"))


class Graph:
    """The repeated edges of documents as segments, paths and spans."""

    def __init__(self, docs: DataFrame, shape: Shape = SHAPE):
        self.shape = shape
        rows = placed(on_files(docs))
        self.rows = rows.select("place", F.col("doc.text").alias("text"))
        place = rows.schema["place"].dataType.simpleString()
        counted = self.rows.select("text").mapInArrow(_hashes(shape), "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = docs.sparkSession.sparkContext.broadcast(key_filter(kept(counted.select("h"), "anchors")))
        self.found = kept(self.rows.mapInArrow(_bundled(again, shape), f"place {place}, start bigint, n int, h bigint, c binary"), "bundles", "zstd")
        self.segments = self._segments()
        self.own = self._occurrences()
        self.paths = self._paths()

    def _segments(self) -> DataFrame:
        """segment, c, first (place, start), lo, m: the repeated runs of m edges of each class."""
        classes = self.found.groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("place", "start")).alias("first"), F.first("n").alias("n"), F.first("h").alias("h"))
        classes = kept(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
        shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min("copies").alias("fewest")).where("members > 1 and fewest = 1")  # else all is known
        wanted = classes.join(kept(shared.select("h"), "branching"), "h", "left_semi").select(F.col("first.place").alias("p"), F.struct(F.col("first.start").alias("start"), "n", F.struct("class", F.col("copies").alias("copies")).alias("class")).alias("w"))
        edges = kept(_fetched(self.rows, wanted, _edges(self.shape), "class struct<class: bigint, copies: bigint>, off int, k binary"), "edges", "zstd")
        again = edges.groupBy("k").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        hit = edges.where("class.copies = 1").join(again.select("k"), "k", "left_semi").select("class.class", "off")
        run = F.col("off") - F.row_number().over(Window.partitionBy("class").orderBy("off"))  # a class has window - gram + 1 edges at most
        parts = hit.withColumn("run", run).groupBy("class", "run").agg(F.min("off").alias("lo"), F.count(F.lit(1)).cast("int").alias("m")).drop("run")
        whole = classes.where("copies > 1").select("c", "first", F.lit(0).alias("lo"), F.col("n").alias("m"))
        some = classes.where("copies = 1").join(parts, "class").select("c", "first", "lo", "m")
        return kept(whole.union(some).withColumn("segment", F.monotonically_increasing_id()), "segments")

    def _occurrences(self) -> DataFrame:
        """place, start, m, segment: the repeated edges of each document from `start` on; start counts words."""
        own = self.found.select("place", "start", "c").join(self.segments.select("c", "segment", "lo", "m"), "c")
        return kept(own.select("place", (F.col("start") + F.col("lo")).alias("start"), F.col("m"), "segment"), "occurrences", "zstd")

    def _paths(self) -> DataFrame:
        """segment, path, at, m, first, lo, last: where each segment lies in its path."""
        order = Window.partitionBy("place").orderBy("start")  # one document's segments
        ahead = F.struct(F.lead("start").over(order).alias("start"), F.lead("segment").over(order).alias("segment"))
        links = self.own.withColumn("ahead", ahead).where("ahead.start = start + m").groupBy(F.col("segment").alias("a"), F.col("ahead.segment").alias("b")).agg(F.min(F.col("m").cast("bigint")).alias("m"))
        joined = compacted(kept(links, "links")).select(F.col("node").alias("segment"), "path", "at")
        paths = self.segments.join(joined, "segment", "left").select("segment", F.coalesce("path", "segment").alias("path"), F.coalesce("at", F.lit(0)).alias("at"), "m", "first", "lo")
        last = paths.groupBy("path").agg(F.max("at").alias("end"))
        return kept(paths.join(last, "path").withColumn("last", F.col("at") == F.col("end")).drop("end"), "paths")

    def spans(self) -> DataFrame:
        """place, start, size, m, path, at: m repeated edges of a document from the word `start`, those of the path from `at` on.

        size is m, or with the words behind the last edge's first, where the next span does not begin there."""
        own = self.own.join(self.paths.select("segment", "path", "at"), "segment")
        order = Window.partitionBy("place").orderBy("start")
        goes_on = (F.lag("path").over(order) == F.col("path")) & (F.lag(F.col("start") + F.col("m")).over(order) == F.col("start")) & (F.lag(F.col("at") + F.col("m")).over(order) == F.col("at"))
        own = own.withColumn("first", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("span", F.sum("first").over(order))
        own = own.groupBy("place", "span").agg(F.min("start").alias("start"), F.sum("m").alias("m"), F.first("path").alias("path"), F.min("at").alias("at"))
        touches = F.coalesce(F.lead("start").over(order) == F.col("start") + F.col("m"), F.lit(False))
        return own.select("place", "start", "m", F.when(touches, F.col("m")).otherwise(F.col("m") + self.shape.window - 1).alias("size"), "path", "at")

    def blocks(self) -> DataFrame:
        """path, block, words: the words of each path, `block` at a time, from its segments' first copies."""
        size = F.when(F.col("last"), F.col("m") + self.shape.window - 1).otherwise(F.col("m"))
        source = self.paths.select(F.col("first.place").alias("p"), "path", "at", size.alias("size"), (F.col("first.start") + F.col("lo")).alias("word"))
        wanted = _pieces(source, self.shape.block).select("p", F.struct(F.col("word").alias("start"), "n", "path", "block", F.col("inner").cast("int").alias("inner")).alias("w"))
        parts = _fetched(self.rows, wanted, _read, "path bigint, block bigint, inner int, words string")
        text = F.concat_ws(" ", F.sort_array(F.collect_list(F.struct("inner", "words"))).getField("words"))  # `block` words
        return parts.groupBy("path", "block").agg(text.alias("words"))

    def passages(self) -> DataFrame:
        """path, n_words, n_spans, n_documents, first: each repeated passage that does not branch, how often it or a part of it occurs, and where."""
        sizes = self.paths.where("last").select("path", (F.col("at") + F.col("m") + self.shape.window - 1).alias("n_words"))
        uses = self.spans().groupBy("path", "place").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
        uses = uses.groupBy("path").agg(F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_documents"), F.min(F.struct("place", "start")).alias("first"))
        return sizes.join(uses, "path")


def _cut(text: bool):
    """doc, text, pieces (word, n, what the n words should be) -> doc, n_words, n_removed, digest of what stays and, if `text`, what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            out: list[list] = [[], [], [], []]
            for r in range(b.num_rows):
                words = Words(b.column(1).slice(r, 1))
                n, gone = len(words.starts), np.zeros(len(words.starts), bool)
                whole, at = words.join()
                for p in b.column(2)[r].as_py() or ():
                    x, y = p["word"], p["word"] + p["n"]
                    if whole[at[x] : at[y] - 1] == p["source"].encode():
                        gone[x:y] = True
                stays = np.repeat(~gone, np.diff(at))
                left = np.asarray(whole)[stays].tobytes()[:-1]
                for o, v in zip(out, (n, int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode() if text else None), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc", "n_words", "n_removed", "kept_sha256", "left"])

    return run


def removed(docs: DataFrame, text: bool = True, shape: Shape = SHAPE) -> DataFrame:
    """For each row of docs: doc (its columns), n_words, n_removed, kept_sha256, and `left`, the words that stay, joined by blanks.

    Without `text`, left is null."""
    docs = on_files(docs)
    graph = Graph(docs, shape)
    spans = _pieces(graph.spans().withColumnsRenamed({"place": "p", "start": "word"}), shape.block)
    source = F.array_join(F.slice(F.split("words", " "), F.col("inner").cast("int") + 1, F.col("n")), " ").alias("source")
    pieces = spans.join(kept(graph.blocks(), "blocks", "zstd"), ["path", "block"]).select("p", F.struct("word", "n", source).alias("piece"))
    pieces = kept(pieces.groupBy("p").agg(F.collect_list("piece").alias("pieces")), "pieces", "zstd")  # as long as the document
    hit, clear = split_possibly(placed(docs), key_filter(pieces.select(F.xxhash64("p"))), F.xxhash64("place"))
    body, kind = F.col("doc.text").alias("body"), pieces.schema["pieces"].dataType
    found = hit.join(pieces, F.col("place") == F.col("p"), "left").select("doc", body, "pieces").unionByName(clear.select("doc", body, F.lit(None).cast(kind).alias("pieces")))
    schema = f"doc {placed(docs).schema['doc'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string, left string"
    return found.mapInArrow(_cut(text), schema)


QUERY = "op11_passages"

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM x),
hit AS (SELECT r, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM hit),
stays AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS left_words
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(left_words, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN stays USING (r)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"), False).select("doc.doc_id", "n_words", "n_removed", "kept_sha256")
