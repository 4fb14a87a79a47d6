"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of WINDOW words (a shorter item is one window). For exact containment every shingle of a
window must occur in the document, so one necessary prefix token is enough: the shingle that is rarest over all documents.

1. Every document is tokenised once, in arrays. A bit filter of fixed size over all benchmark shingles keeps the
   stretches of words whose shingles may all be known; each window that occurs lies within one stretch.
2. The shingles of the stretches are counted over all documents; each distinct window takes its rarest one as prefix.
3. Stretches join windows on the prefix token; positional and length bounds (the window must begin and end within the
   stretch) come before the exact comparison of the words.

Words: A-Z lowered, runs of a-z, 0-9 and code points above 0x7F. Null and empty texts have no words and no hits. Items
without words have no windows. Rows with the same doc_id are treated each by itself. Equal item ids count once in n_items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import LOWERED, kept, on_files, placed, runs, shingled, slices, table, utf8, word_hashes
from tapewright.llm.filters import key_filter, known

WINDOW, SHINGLE = 10, 5
STRETCH_WORDS = 2000  # a longer stretch is dealt out in overlapping parts

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class Words:
    """Word boundaries, hashes and text of the rows of a byte buffer."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = LOWERED[raw]
        self.starts, self.ends = runs(_WORD[self.raw], offsets)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = word_hashes(self.raw, self.starts, self.ends, 3)

    def text(self, a: int, b: int) -> str:
        """Words a to b, joined by blanks."""
        raw = self.raw
        return b" ".join(raw[x:y].tobytes() for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)).decode("utf-8", "replace")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> a row for each window: its words and the hashes of its shingles, in order."""
    for b in batches:
        raw, offsets = utf8(b.column(1))
        ids = b.column(0).to_pylist()
        w = Words(raw, offsets)
        out = {"item_id": [], "words": [], "n": [], "shingles": []}
        for i, (x, y) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
            if x == y:
                continue
            size = min(WINDOW, y - x)
            h, _ = shingled(w.hashes[x:y], np.array([0, y - x]), min(SHINGLE, size))
            for s in range(y - x - size + 1):
                out["item_id"].append(ids[i])
                out["words"].append(w.text(x + s, x + s + size))
                out["n"].append(size)
                out["shingles"].append(h[s : s + size - min(SHINGLE, size) + 1].view(np.int64))
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(out["item_id"], b.schema.field(0).type), "words": pa.array(out["words"], pa.string()), "n": pa.array(out["n"], pa.int32()), "shingles": pa.array(out["shingles"], pa.list_(pa.int64()))})


STRETCHES = "array<struct<size: int, first: bigint, words: array<string>, shingles: array<bigint>>>"


def _stretches(sent, least: dict[int, int]):
    """place, doc_id, text -> n_words and the stretches that may hold windows: shingle size, first word, words, shingles.

    least: for each size of shingles, the fewest that a window has.
    """
    kind = pa.list_(pa.struct([("size", pa.int32()), ("first", pa.int64()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))]))

    def run(batches):
        held = sent.value
        for whole in batches:
            _, sizes = utf8(whole.column(2))
            for x, y in slices(sizes):
                b = whole.slice(x, y - x)
                w = Words(*utf8(b.column(2)))
                found: list[list[dict]] = [[] for _ in range(b.num_rows)]
                for k, fewest in least.items():
                    h, bounds = shingled(w.hashes, w.bounds, k)
                    s, e = runs(known(held, h), bounds)
                    ok = e - s >= fewest
                    s, e = s[ok], e[ok]
                    row = np.searchsorted(bounds, s, "right") - 1
                    for r, a, z in zip(row.tolist(), s.tolist(), e.tolist(), strict=True):
                        base = int(w.bounds[r] - bounds[r])
                        for c in range(a, z, STRETCH_WORDS):
                            d = min(z, c + STRETCH_WORDS + WINDOW - k)
                            first, end = base + c, base + d + k - 1
                            found[r].append({"size": k, "first": first - int(w.bounds[r]), "words": w.text(first, end).split(" "), "shingles": h[c:d].view(np.int64).tolist()})
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(w.bounds), pa.int64()), pa.array(found, kind)], ["place", "doc_id", "n_words", "stretches"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of docs: place, doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark, docs = docs.sparkSession, on_files(docs)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = kept(items.mapInArrow(_windows, "item_id string, words string, n int, shingles array<bigint>"), "windows")
    fewest = windows.groupBy(F.least(F.lit(SHINGLE), "n").alias("k")).agg(F.min(F.size("shingles")).alias("least")).collect()  # SHINGLE rows at most
    sent = spark.sparkContext.broadcast(key_filter(windows.select(F.explode("shingles"))))
    rows = placed(docs)
    place = rows.schema["place"].dataType.simpleString()
    base = kept(
        rows.select("place", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
        .mapInArrow(_stretches(sent, {r.k: r.least for r in fewest}), f"place {place}, doc_id {rows.schema['doc'].dataType['doc_id'].dataType.simpleString()}, n_words bigint, stretches {STRETCHES}"),
        "stretches",
    )
    reach = WINDOW - 1
    tokens = (
        base.select("place", F.explode("stretches").alias("t"))
        .select("place", "t.size", "t.first", "t.words", F.posexplode("t.shingles").alias("at", "h"))
        .select("place", "size", "first", "at", "h", F.greatest(F.col("at") - reach, F.lit(0)).alias("from"), "words")
        .withColumn("near", F.slice("words", F.col("from") + 1, F.lit(2 * reach + SHINGLE + 1)))
        .drop("words")
    )
    counted = kept(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "shingle_counts")
    distinct = windows.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    rarest = (
        distinct.select("words", "n", F.size("shingles").alias("all"), F.posexplode("shingles").alias("pos", "h"))
        .join(counted, "h")
        .groupBy("words", "n", "all")
        .agg(F.min(F.struct("df", "pos", "h")).alias("p"), F.count(F.lit(1)).alias("seen"))
        .where("seen = all")  # a shingle that occurs nowhere rules the window out
    )
    prefix = kept(rarest.select(F.col("p.h").alias("h"), F.col("p.pos").alias("pos"), F.col("n").alias("len"), F.col("words").alias("window")), "prefixes")
    start = F.col("at") - F.col("pos")
    same = F.array_join(F.slice("near", start - F.col("from") + 1, F.col("len")), " ") == F.col("window")
    hits = (
        tokens.join(prefix, "h")
        .where((F.col("size") == F.least(F.lit(SHINGLE), "len")) & (start >= 0) & (start < STRETCH_WORDS) & (start - F.col("from") + F.col("len") <= F.size("near")))
        .where(same)
        .select("place", (F.col("first") + start).alias("start"), (F.col("first") + start + F.col("len")).alias("end"), "window")
    )
    hits = kept(hits, "hits")
    past = Window.partitionBy("place").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(past), F.lit(0).cast("long"))))
    # Items: windows with the same items share a set; documents with the same sets share a combination.
    sets = windows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(F.col("words").alias("window"), F.sha2(F.array_join("items", ","), 256).alias("set"), "items")
    sets = kept(sets, "item_sets")
    per = (
        hits.join(sets.select("window", "set"), "window")
        .select("place", "set", new.alias("new"))
        .groupBy("place").agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("set")).alias("sets"))
        .withColumn("combination", F.sha2(F.array_join("sets", ","), 256))
    )
    per = kept(per, "hit_documents")
    combined = (
        per.groupBy("combination").agg(F.first("sets").alias("sets"))
        .select("combination", F.explode("sets").alias("set"))
        .join(sets.select("set", "items").dropDuplicates(["set"]), "set")
        .select("combination", F.explode("items").alias("item_id")).distinct()
        .groupBy("combination").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
        .select("combination", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    )
    found = per.join(kept(combined, "combinations"), "combination").select(F.col("place").alias("p"), "n_hit", "n_items", "items_sha256")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(kept(found, "found"), F.col("place") == F.col("p"), "left").select(
        "place", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any window of the benchmark, with their columns."""
    docs = on_files(docs)
    gone = kept(contamination(docs, benchmark).where("contaminated").select(F.col("place").alias("gone")), "contaminated")
    return placed(docs).join(gone, F.col("place") == F.col("gone"), "left_anti").select("doc.*")


QUERY = "op3_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("place")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM bs),
ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM ds WHERE array_to_string(w[s : s + n - 1], ' ') IN (SELECT k FROM bw)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h JOIN bw USING (k, n)) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
