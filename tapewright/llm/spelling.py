"""Spelling variants: words one edit apart, found by walking a trie as joins of states with a table of nodes, level by level.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, counted over all documents. Two are near if one inserted,
deleted or replaced code point makes one of the other. The variant's form is its most frequent near word, if that is `ratio`
times as frequent or more; its root is where forms lead in the end.

1. Trie. A node is a prefix that two words share or more; it has an edge for each code point (or end) that follows, and an edge
   which one word alone takes carries the rest of that word. An edit in the second half of a word leaves its first half, and one in the
   first half leaves the second half of the reversed word, so there are two tries, and only nodes below the halves exist.
2. Frontier. States (word, position, node, edits) begin with each word at its half. At each level they join the nodes of that
   depth, each of which is read once: a state without edits goes on along its own code point, or takes an edit where it leaves
   its path: another code point in place of its own, or its own left out. A state with an edit goes on along its own code point
   only. Where one word is left on an edge, what is left of both is compared at once. What ends with one edit is a pair;
   insertions are deletions seen from the other word, and of two code points only the lesser is replaced.
3. Words of over LONG code points, which no language has, would make as many levels: they are matched by 64-bit keys of what each
   deletion leaves, one for each code point, and pairs are compared as texts. The two meet for words of LONG and LONG + 1.

A node has at most 97 edges (the alphabet and the end). Equal code points are told by the words themselves, not by hashes.

Null texts have no words; a null doc_id is written as nothing before the colon. Rows with equal doc_id count each. Without words
there are no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import LOWERED, Roller, kept, runs, table, text_batches, utf8
from tapewright.sources.scratch import place

LEAST = 7  # code points of a word
OFTEN = 2  # occurrences of a word
SPOILT = 31  # one occurrence in so many loses a code point
RATIO = 10
LONG = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # of U+00C0 to U+00FF, which have one byte more


def _spoilt(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id as text, text -> word, n: the words of each batch; the crc32 of id and word decides which occurrences are spoilt."""
    for b in text_batches(batches, 1):
        raw, offsets = utf8(b.column(1))
        raw = LOWERED[raw]
        lead = raw == _LEAD
        mask = _LETTER[raw] | lead
        mask[1:] |= lead[:-1]
        starts, ends = runs(mask, offsets)
        leads = np.concatenate([[0], np.cumsum(lead)])
        keep = ends - starts - (leads[ends] - leads[starts]) >= LEAST
        starts, ends = starts[keep], ends[keep]
        bounds = np.searchsorted(starts, offsets).tolist()
        cut = list(map(slice, starts.tolist(), ends.tolist()))
        whole, total = raw.tobytes(), Counter()
        for key, x, y in zip(b.column(0).to_pylist(), bounds, bounds[1:], strict=False):
            seed = zlib.crc32(f"{'' if key is None else key}:".encode())
            for w, n in Counter(map(whole.__getitem__, cut[x:y])).items():
                h = zlib.crc32(w, seed)
                total[w if h % SPOILT else _spoilt(w, h)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all documents."""
    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counted, "word binary, n long")
    words = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).select(F.decode("word", "UTF-8").alias("word"), "n")
    return kept(words.where(F.char_length("word") >= LEAST), "words")


def _levelled(df: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """df written by depth, so that each level reads its own rows only."""
    path = place(spark, name)
    df.write.partitionBy("depth").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _walked(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: near words of at most LONG code points, each pair once or twice in one order."""
    spark = words.sparkSession
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")
    both = words.where(size <= LONG).select("word", "n", F.lit(False).alias("back"), half.alias("start"))
    both = both.union(words.where(size <= LONG).select(F.reverse("word"), "n", F.lit(True), size - half))
    passed = both.select("back", "word", "n", F.explode(F.sequence("start", size)).alias("depth"))
    node, c = F.substring("word", F.lit(1), F.col("depth")), F.substring("word", F.col("depth") + 1, F.lit(1))
    rest = F.substring("word", F.col("depth") + 2, size)
    edges = passed.select("back", "depth", node.alias("node"), c.alias("c"), rest.alias("rest"), "n")
    edges = edges.groupBy("back", "depth", "node", "c").agg(F.count(F.lit(1)).alias("words"), F.min("rest").alias("rest"), F.min("n").alias("n"))
    edge = F.struct("c", F.when(F.col("words") == 1, F.col("rest")).alias("rest"), F.col("n").alias("n_b"))
    nodes = edges.groupBy("back", "depth", "node").agg(F.sum("words").alias("words"), F.collect_list(edge).alias("edges"))  # 97 edges at most
    nodes = _levelled(nodes.where("words > 1").drop("words"), "nodes", spark)
    begun = both.select("back", "word", "n", F.col("start").alias("position"), F.substring("word", F.lit(1), F.col("start")).alias("node"), F.lit(0).alias("edits"), F.col("start").alias("depth"))
    begun = _levelled(begun, "begun", spark)
    depths = sorted(r.depth for r in nodes.select("depth").distinct().collect())  # LONG numbers at most
    frontier = begun.limit(0)
    pairs = []
    for depth in range(depths[0], depths[-1] + 1) if depths else ():
        states = frontier.unionByName(begun.where(F.col("depth") == depth))
        met = states.join(nodes.where(F.col("depth") == depth).drop("depth"), ["back", "node"])
        letter = lambda k: F.substring("word", F.col("position") + k, F.lit(1))
        tail = lambda k: F.substring("word", F.col("position") + k, F.char_length("word"))
        met = met.select("back", "word", "n", "position", "node", "edits", letter(1).alias("own"), letter(2).alias("after"), tail(2).alias("tail"), tail(3).alias("tail2"), F.explode("edges").alias("e"))
        own, c, only = F.col("own"), F.col("e.c"), F.col("e.rest").isNotNull()
        fresh = (F.col("edits") == 0) & (own != "")
        fits = lambda t: ~only | (F.col("e.rest") == F.col(t))
        stays = fresh & (c == own) & ~only
        other, less = fresh & (c > own) & fits("tail"), fresh & (c == F.col("after")) & (c != own) & fits("tail2")
        goes_on = (F.col("edits") == 1) & (c == own) & fits("tail")
        taken = lambda k, edits: F.struct((F.col("position") + k).alias("position"), edits.cast("int").alias("edits"))
        steps = F.array(F.when(stays | other | goes_on, taken(1, F.when(stays, 0).otherwise(1))), F.when(less, taken(2, F.lit(1))))
        met = met.where(stays | other | less | goes_on).withColumn("x", F.explode(steps)).where("x IS NOT NULL")
        met = met.select("back", "word", "n", "x.position", F.concat("node", "e.c").alias("node"), "x.edits", F.lit(depth + 1).alias("depth"), "e.rest", "e.n_b")
        met = kept(met, "level")
        pairs.append(met.where("rest IS NOT NULL").select("back", "word", "n", F.concat("node", "rest").alias("b"), "n_b"))
        frontier = met.where("rest IS NULL").drop("rest", "n_b")
    if not pairs:
        return words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b")).limit(0)
    found = pairs[0]
    for p in pairs[1:]:
        found = found.union(p)
    turned = lambda x: F.when(F.col("back"), F.reverse(x)).otherwise(F.col(x))
    return found.select(turned("word").alias("a"), F.col("n").alias("n_a"), turned("b").alias("b"), "n_b")


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, number -> number, and the key of the whole (at -1) and of what is left without each code point (at its place)."""
    for b in text_batches(batches, 0):
        raw, offsets = utf8(b.column(0))
        for r, number in enumerate(b.column(1).to_pylist()):
            part = raw[offsets[r] : offsets[r + 1]]
            sums = Roller(part).sums
            starts = np.flatnonzero((part & 0xC0) != 0x80)
            ends = np.append(starts[1:], len(part))
            keys = np.append(sums[-1], sums[starts] + (sums[-1] - sums[ends]) * Roller._inverse[ends - starts])
            at = np.arange(-1, len(starts), dtype=np.int32)
            for x in range(0, len(keys), 1 << 16):
                m = len(keys[x : x + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([number] * m, pa.int64()), pa.array(keys[x : x + m].view(np.int64)), pa.array(at[x : x + m])], ["number", "key", "at"])


def _deleted(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: near words of at least LONG code points, from keys of deletions; words that agree in a key are compared."""
    words = words.where(F.char_length("word") >= LONG).withColumn("number", F.monotonically_increasing_id())
    words = kept(words, "long")
    keys = words.select("word", "number").mapInArrow(_deletions, "number long, key long, at int")
    keys = kept(keys, "deletions")
    left, right = keys.select(F.col("number").alias("x"), "key", "at"), keys.select(F.col("number").alias("y"), F.col("key").alias("other"), F.col("at").alias("there"))
    same = (F.col("key") == F.col("other")) & (F.col("at") >= 0)
    replaced = left.join(right, same & (F.col("at") == F.col("there"))).select("x", "y", "at", F.lit(True).alias("replaced"))
    shorter = left.join(right.where("there = -1"), same).select("x", "y", "at", F.lit(False).alias("replaced"))
    side = lambda k, v: words.select(F.col("number").alias(k), F.col("word").alias(v), F.col("n").alias(f"n_{v}"))
    met = replaced.union(shorter).join(side("x", "a"), "x").join(side("y", "b"), "y")
    head, tail = F.substring("a", F.lit(1), F.col("at")), F.substring("a", F.col("at") + 2, F.char_length("a"))
    rest = F.when(F.col("replaced"), F.substring("b", F.col("at") + 2, F.char_length("b"))).otherwise(F.substring("b", F.col("at") + 1, F.char_length("b")))
    return met.where((head == F.substring("b", F.lit(1), F.col("at"))) & (tail == rest) & (~F.col("replaced") | (F.col("a") < F.col("b")))).select("a", "n_a", "b", "n_b")


def near(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words in both orders, once. words (word, n) should lie on disk."""
    found = _walked(words).union(_deleted(words)).distinct()
    return found.union(found.select("b", "n_b", "a", "n_a"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: where forms lead in the end. Each round doubles the steps; counts grow along forms, so they end."""
    found = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        seen = Observation()
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = found.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        found = kept(step.observe(seen, F.count_if("moved").alias("moved")), "roots").drop("moved")
        if not seen.get["moved"]:
            return found


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n; words are distinct).

    A form is the near word of largest n, ties the least in code-point order, if that n is `ratio` times the word's or more."""
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    of = near(words).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(of, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    rows = kept(rows, "forms")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """The words of all documents (doc_id, text), each with its form and root."""
    return grouped(vocabulary(docs), ratio)


QUERY = "op12_spelling"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
