"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; groups of linked documents.

1. Every text becomes its set of shingles. Documents with equal sets form a class, and one class is joined once.
   Shingles and words are counted over all documents in sketches of fixed size, which give one order for all: rare first.
   A sketch of shingles knows only those that are very common, as most are unique and share its counters; the others are
   ordered by how common their words are together. So what a prefix holds stays rare however many documents there are.
2. Two sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles in that order: the prefix.
   Prefix shingles of two or more classes form buckets. In each, first every member is paired with one pivot; links found
   so join most of a group of copies without making all its pairs. Then pairs of members that are not in one component
   yet are made, so no link between components is lost.
3. A pair must pass the length filter, the positional filter and a bound on what its prefixes share. It is made distinct and
   must pass the suffix filter - how differently the two sets fill the parts of the hash space, kept beside the prefix -
   before any text is fetched for it. It is verified once: pairs of the first round do not come back in the second.

Shingles are known by 64-bit hashes that mix every byte with its place (common.word_hashes) and every word in turn; a pair
that links by them is compared by its words before it counts, so a collision cannot link two documents.

Words: A-Z lowered, runs of other than blank, tab, line feed, vertical tab, form feed, carriage return. A text of fewer than
k words is one shingle. Null and empty texts have no shingles and link with nothing. Rows with equal doc_id are rows of
their own; a null doc_id is never a component's least id unless it has no other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import LOWERED, U64, dropped, kept_alone, mixed, narrow, on_files, placed, runs, shingled, table, text_batches, utf8, word_hashes
from tapewright.llm.components import components
from tapewright.llm.filters import key_filter, possibly, split_possibly

COUNTERS = 1 << 21
WORDS = 1 << 18  # counters of words
PART = 1 << 13
BINS = 16  # of the hash space, for the suffix filter
MEMBERS = 64  # of a bucket whose members are paired directly; beyond it they are compared by their differences from its pivot

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin, with the end."""
    raw, offsets = utf8(column)
    raw = LOWERED[raw]
    starts, ends = runs(_WORD[raw], offsets)
    words = word_hashes(raw, starts, ends, 5) if len(starts) else np.zeros(0, U64)
    return words, np.searchsorted(starts, offsets)


def _sets(words: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for s, _ in _weighed(words, bounds, k, None)]


def _weighed(words: np.ndarray, bounds: np.ndarray, k: int, weights: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The sorted distinct shingle hashes of each text and, if words have weights, their sum over each one's words."""
    h, at = shingled(words, bounds, k)
    sums = None if weights is None else np.concatenate([[0], np.cumsum(weights)])
    for a, b, x, y in zip(at.tolist(), at[1:].tolist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b > a and sums is None:
            yield np.unique(h[a:b]), None
        elif b > a:
            s, first = np.unique(h[a:b], return_index=True)
            yield s, sums[first + x + k] - sums[first + x]
        elif y > x:
            yield shingled(words[x:y], np.array([0, y - x]), y - x)[0] ^ U64(y - x), None if sums is None else sums[y : y + 1] - sums[x : x + 1]
        else:
            yield np.zeros(0, U64), np.zeros(0, np.int64)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    return _sets(*_word_hashes(column), k)


def _counted(h: np.ndarray, counters: int) -> np.ndarray:
    return np.bincount((h & U64(counters - 1)).astype(np.int64), minlength=counters)


def _classes(k: int):
    """place, doc_id, text -> the size and a 128-bit fingerprint of each set; at the end the task's share of the counts of
    shingles, and behind them those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, word_counts = np.zeros(COUNTERS, np.int64), np.zeros(WORDS, np.int64)
        kinds = None
        for b in text_batches(batches, 2):
            kinds = b.schema
            words, bounds = _word_hashes(b.column(2))
            sets = _sets(words, bounds, k)
            if len(words):
                counts += _counted(np.concatenate(sets), COUNTERS)
                word_counts += _counted(words, WORDS)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(mixed(s).sum().view(np.int64)) for s in sets], pa.int64()),
                pa.array([int(mixed(s ^ U64(0xA5A5A5A55A5A5A5A)).sum().view(np.int64)) for s in sets], pa.int64()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ], ["place", "doc_id", "n", "k1", "k2", "slice", "counts"])
        if kinds is not None:
            parts = np.concatenate([counts, word_counts]).reshape(-1, PART)
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, kinds.field(0).type), pa.nulls(n, kinds.field(1).type), *[pa.nulls(n, pa.int64())] * 3,
                pa.array(range(n), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
            ], ["place", "doc_id", "n", "k1", "k2", "slice", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(c), np.int64)
            held[k] = held[k] + x if k in held else x
    for k, x in held.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": [zlib.compress(x.tobytes(), 1)]})


def rarity(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The level of each counter of shingles: 0 up to three standard deviations above the mean, then by the logarithm; and that of
    each counter of words, by the logarithm. COUNTERS + WORDS bytes."""
    out = np.zeros(((COUNTERS + WORDS) // PART, PART))
    for r in narrow(counts.repartition("slice")).mapInArrow(_summed, "slice int, counts binary").collect():
        out[r.slice] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    flat, words = np.split(out.ravel(), [COUNTERS])
    spread = np.sqrt(max(1.0, flat.mean()))  # of counters that hold rare shingles only
    levels = np.clip(1 + 4 * np.log2(np.maximum((flat - flat.mean()) / (3 * spread), 0.5)), 0, 255).astype(np.uint8)
    return levels, np.clip(6 * np.log2(1 + words), 0, 255).astype(np.uint8)


def _prefixes(k: int, per_cent: int, sent):
    """place, text -> how common the prefix is, the set's counts by part of the hash space, and the prefix in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, word_level = sent.value
        for b in text_batches(batches, 1):
            scores, bins, out = [], [], []
            words, bounds = _word_hashes(b.column(1))
            weights = word_level[(words & U64(WORDS - 1)).astype(np.int64)].astype(np.int64)
            for s, weight in _weighed(words, bounds, k, weights):
                n = len(s)
                size = n - -(-per_cent * n // 100) + 1 if n else 0
                own = level[(s & U64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((weight, own))[:size]  # stable: then by hash
                out.append(s[order].view(np.int64))
                bins.append(np.bincount((s >> U64(60)).astype(np.int64), minlength=BINS).astype(np.int32))
                scores.append(float(np.exp2(own[order] / 4.0).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(bins, pa.list_(pa.int32())), pa.array(out, pa.list_(pa.int64()))], ["place", "score", "bins", "prefix"])

    return run


def similar(x: np.ndarray, y: np.ndarray, per_cent: int) -> bool:
    """100 * intersection >= per_cent * union, for sorted sets."""
    need = -(-per_cent * (len(x) + len(y)) // (100 + per_cent))
    return min(len(x), len(y)) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need


def _word_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(LOWERED.tobytes()))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _verified(k: int, per_cent: int):
    """a, b, wide, text of a, text of b -> linked, the sizes, and for wide pairs what b has more and less than a.

    Rows lie by a, so a's set is mostly at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, words = None, None, None
        for b in text_batches(batches, 4):
            out: list[list] = [[] for _ in range(8)]
            texts = b.column(3)
            sets = shingle_sets(b.column(4), k)
            for i, (p, q, wide) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                y = sets[i]
                if p != last:
                    last, x, words = p, shingle_sets(texts.slice(i, 1), k)[0], None
                linked = similar(x, y, per_cent)
                if linked:
                    words = words or _word_shingles(texts[i].as_py(), k)
                    own = _word_shingles(b.column(4)[i].as_py(), k)
                    linked = 100 * len(words & own) >= per_cent * len(words | own)
                more, less = (np.setdiff1d(y, x, True).view(np.int64), np.setdiff1d(x, y, True).view(np.int64)) if wide else (None, None)
                for o, v in zip(out, (p, q, wide, linked, len(x), len(y), more, less), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], ["a", "b", "wide", "linked", "na", "nb", "more", "less"])

    return run


def _once(pairs: DataFrame) -> DataFrame:
    """One row for each two classes, from rows (pivot a, b, wide): a is a pivot, and one of a large bucket if either is.

    wide: 1 if a is the pivot of a large bucket with b, 2 if b is one with a, 3 for both."""
    low = F.col("a") < F.col("b")
    flag = F.when(F.col("wide") > 0, F.when(low, 1).otherwise(2)).otherwise(F.when(low, 4).otherwise(8))
    both = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.bit_or(flag).alias("f"))
    swap = F.expr("f & 3 = 2 or f & 3 = 0 and f & 12 = 8")
    wide = F.expr("f & 3").cast("int")
    return both.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), F.when(swap & (wide == 2), 1).otherwise(wide).alias("wide"))


class Join:
    """The join of one table of documents; links come in two rounds. Tables are deleted as soon as nothing reads them again."""

    def __init__(self, docs: DataFrame, k: int, per_cent: int):
        self.k, self.per_cent = k, per_cent
        self.spark = docs.sparkSession
        rows = placed(on_files(docs))
        place = rows.schema["place"].dataType.simpleString()
        doc_id = rows.schema["doc"].dataType["doc_id"].dataType.simpleString()
        self.texts = rows.select("place", F.col("doc.text").alias("text"))
        self.both = both = kept_alone(
            rows.select("place", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
            .mapInArrow(_classes(k), f"place {place}, doc_id {doc_id}, n bigint, k1 bigint, k2 bigint, slice int, counts binary"),
            "sets",
        )
        self.rows = both.where("slice is null").drop("slice", "counts")
        level = self.spark.sparkContext.broadcast(rarity(both.where("slice is not null").select("slice", "counts")))
        classes = self.rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("place").alias("place"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("least"))
        self.classes = kept_alone(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
        signed = self.texts.mapInArrow(_prefixes(k, per_cent, level), f"place {place}, score double, bins array<int>, prefix array<bigint>")
        self.signed = kept_alone(signed.join(self.classes.select("place", "class", F.col("n").cast("int").alias("n")), "place"), "prefixes")

    def roots(self) -> DataFrame:
        """node, root of every class that links with another."""
        tokens = self.signed.select("class", "n", "score", F.posexplode("prefix").alias("pos", "h"))
        # Most shingles of prefixes are in one class only: numbers alone are shuffled to know the others.
        again = kept_alone(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("h"), "again")
        tokens = possibly(tokens, key_filter(again), F.col("h"))
        buckets = kept_alone(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("score", "class", "n", "pos")).alias("m")).where("members > 1"), "buckets")
        # The pivot is the member whose prefix is most common: what a group of copies has in common, not one much edited.
        shared = kept_alone(tokens.drop("score").join(buckets.select("h", "members", F.col("m.class").alias("p"), F.col("m.n").alias("np"), F.col("m.pos").alias("pp")), "h"), "shared")
        self.sizes = kept_alone(self.signed.select("class", "place", "n", "bins"), "sizes")
        dropped(again, buckets, self.signed)
        small, large = shared.where(F.col("members") <= MEMBERS), shared.where(F.col("members") > MEMBERS)
        stars = small.where("class <> p").select(F.col("p").alias("a"), F.col("class").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb"), F.col("pp").alias("pa"), F.col("pos").alias("pb"))
        near = self._pairs(stars, 2).withColumn("wide", F.lit(0))  # a pair is seen in some of its buckets only: half will do
        wide = large.where("class <> p").select(F.col("p").alias("a"), F.col("class").alias("b"), F.lit(1).alias("wide"))
        first = self._verify(_once(near.union(wide)), "stars")
        roots = components(first.where("linked").select("a", "b"))
        part = small.select("h", "class", "n", "pos").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")
        open_ = part.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("h")
        left = kept_alone(part.join(open_, "h", "left_semi"), "open_members")
        dropped(shared)
        x, y = (left.select("h", *(F.col(c).alias(f"{c}{s}") for c in ("class", "n", "pos", "root"))) for s in "ab")
        pairs = x.join(y, "h").where("classa < classb and roota <> rootb").select(F.col("classa").alias("a"), F.col("classb").alias("b"), "na", "nb", F.col("posa").alias("pa"), F.col("posb").alias("pb"))
        around, differences = self._around_pivots(first.where("wide > 0"), roots)
        more = self._pairs(pairs, 1).union(around).distinct()
        done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        late = self._verify(more.join(done, ["a", "b"], "left_anti").withColumn("wide", F.lit(0)), "late").where("linked").select("a", "b")
        dropped(left, differences, first, self.sizes)
        if not late.limit(1).count():
            return roots
        # What the second round links are components of the first: a small graph on their roots.
        up = roots.select(F.col("node").alias("of"), F.col("root").alias("up"))
        ends = late.join(up, F.col("a") == F.col("of"), "left").select(F.coalesce("up", "a").alias("a"), "b").join(up, F.col("b") == F.col("of"), "left").select("a", F.coalesce("up", "b").alias("b"))
        above = components(ends).select(F.col("node").alias("of"), F.col("root").alias("up"))
        new = above.join(roots, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("up").alias("root"))
        return kept_alone(roots.join(above, F.col("root") == F.col("of"), "left").select("node", F.coalesce("up", "root").alias("root")).union(new), "roots")

    def _around_pivots(self, wide: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """a, b (a < b): pairs of members of large buckets that may link though they are in different components; and the table
        that they are read from.

        Each member is known by its difference from the pivot p: x and y link if |dx| + |dy| - 2 |dx & dy| is at most the slack
        D(x, y). Two members that both link to the pivot are in its component. So one, x, does not: |dx| > D(x, p), and since
        D(x, y) - D(x, p) is at most max(0, ny - np), and at most (100 - t) / (100 + t) (ny - np) + 2, x and y must share at
        least `least` elements, more than about half of dy. Hence some element of dx is in y's prefix: all of dy but the last
        least - 1, rare first. If y is far from the pivot - it has less than t of its own elements in common with it - then x and
        y share an element that p lacks, and the prefix is taken of those, with the size of an ordinary one: what p has and
        both lack decides nothing then. Elements whose owners are in one component only come first and join with nothing.
        """
        t = self.per_cent
        slack = lambda n: n - 2 * F.ceil(t * n / (100 + t))
        signs = F.concat(F.transform("more", lambda e: F.struct(e.alias("e"), F.lit(True).alias("own"))), F.transform("less", lambda e: F.struct(e.alias("e"), F.lit(False).alias("own"))))
        d = wide.where("wide & 1 > 0").select("a", "b", "linked", "na", "nb", "more", "less").union(wide.where("wide & 2 > 0").select("b", "a", "linked", "nb", "na", "less", "more"))
        d = d.select(F.col("a").alias("p"), F.col("b").alias("class"), "linked", F.col("na").alias("np"), F.col("nb").alias("n"), F.size("more").cast("bigint").alias("m"), (F.size("more") + F.size("less")).cast("bigint").alias("s"), signs.alias("signs"))
        d = d.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")
        signed = d = kept_alone(d.withColumn("far", 100 * (F.col("n") - F.col("m")) < t * F.col("n")).withColumn("sign", F.explode("signs")).select("p", "class", "linked", "np", "n", "m", "s", "root", "far", "sign.*"), "signs")
        often = kept_alone(d.groupBy("p", "e").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("p", "e", "df"), "elements")
        grown = F.greatest(F.col("n") - F.col("np"), F.lit(0))
        least = F.greatest(F.ceil((F.col("s") + 1 - grown) / 2), F.floor((F.col("s") - (100 - t) / (100 + t) * (F.col("n") - F.col("np")) - 1) / 2) + 1, F.lit(1))
        own = Window.partitionBy("p", "class")
        counts = F.when(F.col("far"), F.col("own")).otherwise(True)  # whether an element may be in the prefix
        size = F.when(F.col("far"), F.least(F.col("n") - F.ceil(t * F.col("n") / 100) + 1, F.col("m"))).otherwise(F.col("s") - least + 1)
        d = d.join(often, ["p", "e"]).withColumn("counts", counts).withColumn("size", size)
        d = d.withColumn("rank", F.row_number().over(own.orderBy(F.desc("counts"), "df", "e"))).withColumn("alone", F.when(F.col("far"), F.col("m")).otherwise(F.col("s")) - F.count_if("counts").over(own))
        d = kept_alone(d.select("p", "e", "class", "linked", "n", "s", "root", (F.col("s") - F.col("size")).alias("rest"), (F.col("counts") & (F.col("rank") + F.col("alone") <= F.col("size"))).alias("prefix")), "differences")
        dropped(signed, often)
        x = d.where("not linked").select("p", "e", *(F.col(c).alias(f"x_{c}") for c in ("class", "n", "s", "root")))
        y = d.where("prefix").select("p", "e", *(F.col(c).alias(f"y_{c}") for c in ("class", "n", "s", "root", "rest")))
        fits = 100 * F.least("x_n", "y_n") >= t * F.greatest("x_n", "y_n")
        met = x.join(y, ["p", "e"]).where("x_root <> y_root").where(fits).groupBy("p", "x_class", "y_class", "x_n", "y_n", "x_s", "y_s", "y_rest").agg(F.count(F.lit(1)).alias("met"))
        enough = 2 * (F.col("met") + F.col("y_rest")) >= F.col("x_s") + F.col("y_s") - slack(F.col("x_n") + F.col("y_n"))
        return met.where(enough).select(F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b")), d

    def _pairs(self, met: DataFrame, share: int) -> DataFrame:
        """a, b of the pairs that may link, from a row for each prefix shingle that two classes share.

        Length: 100 least >= t greatest. Positional: from the first shared shingle on, enough of both sets must be left.
        Prefix overlap: shingles shared outside the prefixes are at most those that lie behind them in the set whose prefix
        ends first, so the prefixes must share the rest (or 1/share of it, where some of their meetings are not in `met`).
        """
        t = self.per_cent
        need = F.ceil(t * (F.col("na") + F.col("nb")) / (100 + t))
        behind = F.greatest(F.ceil(t * F.col("na") / 100), F.ceil(t * F.col("nb") / 100)) - 1
        left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        long = met.where(100 * F.least("na", "nb") >= t * F.greatest("na", "nb"))
        pairs = long.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"), F.max(left).alias("left"))
        return pairs.where((share * F.col("met") >= need - behind) & (F.col("left") >= need)).select("a", "b")

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, wide) that pass the suffix filter or are wide, compared on their whole texts.

        A text is written for each pair of which it is b, and once for all of which it is a; only those of b meet a's by a shuffle."""
        t = self.per_cent
        x, y = (self.sizes.select(F.col("class").alias(s), F.col("place").alias(f"{s}_place"), F.col("n").alias(f"{s}_n"), F.col("bins").alias(f"{s}_bins")) for s in "ab")
        apart = F.aggregate(F.zip_with("a_bins", "b_bins", lambda u, v: F.abs(u - v)), F.lit(0), lambda u, v: u + v)
        n = F.col("a_n") + F.col("b_n")
        may = (F.col("wide") > 0) | (apart <= n - 2 * F.ceil(t * n / (100 + t)))
        pairs = kept_alone(pairs.join(y, "b").join(x, "a").where(may).select("a", "b", "wide", "a_place", "b_place"), "pairs")
        none = F.lit(None)
        pivots = pairs.select(F.col("a_place").alias("place"), "a", none.cast("bigint").alias("b"), none.cast("int").alias("wide")).distinct()
        wanted = kept_alone(pairs.select(F.col("b_place").alias("place"), "a", "b", "wide").union(pivots), "wanted")
        key = F.xxhash64("place")
        texts = kept_alone(possibly(self.texts, key_filter(wanted.select(key)), key).join(wanted, "place").select("a", "b", "wide", "text"), "candidates", "zstd")
        members = texts.where("b is not null").select("a", "b", "wide", F.col("text").alias("tb"))
        both = members.join(texts.where("b is null").select("a", F.col("text").alias("ta")), "a").select("a", "b", "wide", "ta", "tb")
        out = kept_alone(both.mapInArrow(_verified(self.k, t), "a bigint, b bigint, wide int, linked boolean, na bigint, nb bigint, more array<bigint>, less array<bigint>"), name)
        dropped(pairs, wanted, texts)
        return out

    def grouped(self) -> DataFrame:
        """For each row: place, doc_id, n_shingles, component_id, and whether it is the one of its component that stays."""
        roots = self.roots()
        of = self.classes.join(roots, F.col("class") == F.col("node"), "left").select("n", "k1", "k2", "least", F.coalesce("root", "class").alias("root"))
        by_root = kept_alone(of, "class_roots")
        dropped(self.classes, roots)
        least = kept_alone(by_root.groupBy("root").agg(F.min("least").alias("stays")), "least")
        self.of = of = kept_alone(by_root.join(least, "root").select("n", "k1", "k2", "stays"), "class_components")
        dropped(by_root, least)
        alone = self.rows.where("n = 0").select("place", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
        rest = self.rows.where("n > 0").join(of, ["n", "k1", "k2"]).select("place", "doc_id", F.col("n").alias("n_shingles"), F.col("stays.doc_id").alias("component_id"), (F.col("place") == F.col("stays.place")).alias("stays"))
        return alone.union(rest)


def near_groups(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    return Join(docs, k, per_cent).grouped()


def deduplicated(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group of linked documents the one with the least doc_id. Columns are kept.

    Rows that the filter of those that go does not know pass straight through."""
    docs = on_files(docs)
    join = Join(docs, k, per_cent)
    gone = kept_alone(join.grouped().where("not stays").select(F.col("place").alias("gone")), "gone")
    dropped(join.both, join.of)
    some, clear = split_possibly(placed(docs), key_filter(gone.select(F.xxhash64("gone"))), F.xxhash64("place"))
    return clear.select("doc.*").unionByName(some.join(gone, F.col("place") == F.col("gone"), "left_anti").select("doc.*"))


QUERY = "op10_ngram_jaccard"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90).drop("place", "stays")
