"""Scratch tables in the shared folder, and numpy text helpers used inside Arrow tasks."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.sources import scratch
from tapewright.sources.scratch import place

U64 = np.uint64
TOGETHER = 1 << 18  # bytes of text that a task works through at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def kept(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Deletes what an execution has shuffled when it ends; else it lies there until the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept_alone(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """As kept; what the write has shuffled is deleted when it is done."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        return kept(df, name, compression)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that kept wrote and nothing will read again."""
    for t in tables:
        scratch.delete(t.sparkSession, {f.rsplit("/", 2)[-2] for f in t.inputFiles()})


def narrow(df: DataFrame) -> DataFrame:
    """df, a table of bounded size, in at most four partitions a core."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_files(docs: DataFrame) -> DataFrame:
    """docs as they are if they are read from Parquet files, where each row has a place; else written first."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return kept(docs, "docs")


def placed(docs: DataFrame) -> DataFrame:
    """doc (all columns of docs) and place (hash of the file's path, row in it) of docs that lie on files."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), place)


def lower_ascii(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty. offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, int(offsets[-1])) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = TOGETHER):
    """Row ranges [a, b) whose texts have about `most` bytes together; a longer text has a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit hashes (wrapping arithmetic)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _values(seed: int) -> np.ndarray:
    """A 64-bit number for each byte value."""
    return mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Roller:
    """Hashes of any byte range of one buffer, from prefix sums in arithmetic modulo 2**64.

    Long texts made on purpose can collide in this arithmetic, so it serves for hashed features only; what decides whether
    two words or strings are the same is word_hashes or the bytes themselves.
    """

    BASE = 0x5851F42D4C957F2D
    _powers: np.ndarray = np.ones(1, U64)
    _inverse: np.ndarray = np.ones(1, U64)

    def __init__(self, raw: np.ndarray, seed: int = 1):
        n = len(raw) + 1
        if len(Roller._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_powers", Roller.BASE), ("_inverse", pow(Roller.BASE, -1, 1 << 64))):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(Roller, name, np.multiply.accumulate(p))
        self.sums = np.zeros(n, U64)
        np.cumsum(_values(seed)[raw] * Roller._powers[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * Roller._inverse[starts] + (ends - starts).astype(U64))


NEAR = 64  # bytes of a word whose values come from a table
CHUNK = 1 << 18


def _placed_values(place: np.ndarray, raw: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit number for each byte value at each place in its word."""
    return mixed((place.astype(U64) << U64(8) | raw) * U64(0x9E3779B97F4A7C15) + U64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


@functools.cache
def _near_values(seed: int) -> np.ndarray:
    place, raw = np.divmod(np.arange(NEAR * 256), 256)
    return _placed_values(place, raw.astype(U64), seed)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of disjoint byte ranges that are not empty.

    Every byte is mixed with its place in the range before the sum (tabulation), so no arithmetic relation among the bytes
    of a word survives, whatever its length. Works through about CHUNK bytes at a time, and through a longer range alone.
    """
    out = np.zeros(len(starts), U64)
    near = _near_values(seed)
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    for a, b in slices(total, CHUNK):
        if total[b] - total[a] > 4 * CHUNK:  # one word
            for x in range(int(starts[a]), int(ends[a]), CHUNK):
                part = raw[x : min(x + CHUNK, int(ends[a]))]
                out[a : a + 1] += _placed_values(np.arange(x - starts[a], x - starts[a] + len(part)), part.astype(U64), seed).sum()
            continue
        first = total[a:b] - total[a]
        place = np.arange(int(total[b] - total[a])) - np.repeat(first, np.diff(total[a : b + 1]))
        part = raw[place + np.repeat(starts[a:b], np.diff(total[a : b + 1]))]
        v = near[np.minimum(place, NEAR - 1) << 8 | part]
        far = place >= NEAR
        if far.any():
            v[far] = _placed_values(place[far], part[far].astype(U64), seed)
        out[a:b] = np.add.reduceat(v, first)
    return mixed(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; no run crosses a row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    cut = offsets[:-1][offsets[:-1] < len(mask)]
    first[cut] = mask[cut]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    tail = offsets[1:] - 1
    tail = tail[tail >= 0]
    last[tail] = mask[tail]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWERED = lowered()


def shingled(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words that lies within a row, and the bounds of the rows in it.

    words: hashes of the words of all rows; bounds: where each row's words begin, with the end.
    """
    n = len(words)
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if n < k or not counts.sum():
        return np.zeros(0, U64), out
    h = np.full(n - k + 1, k, U64)
    for t in range(k):
        h += words[t : n - k + 1 + t]
        h = mixed(h)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(int(out[-1])) - out[row] + bounds[row]
    return h[at], out


SAMPLE_BYTES = 12 << 20  # of text that a fitted sample may have
SAMPLE_TEXT = 256 << 10  # bytes of the longest text in a sample


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample of the labelled rows that are not held out.

    The sample: the rows of the least hashes of id and text whose texts have at most SAMPLE_TEXT bytes, as many as make `most`
    rows and SAMPLE_BYTES. A document with several labels counts with each. The same rows make the same sample."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # `most` rows of two numbers are sent
    order = ("by", "doc_id", "label", "of_text")
    rows = rows.select(F.xxhash64("doc_id").alias("by"), "doc_id", "label", F.xxhash64("text").alias("of_text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text").where(F.col("size") <= SAMPLE_TEXT)
    rows = kept(rows, "sample")
    sizes = np.cumsum([r.size for r in rows.select(*order, "size").orderBy(*order).limit(most).collect()])  # `most` rows of numbers
    rows = rows.orderBy(*order).limit(int((sizes <= SAMPLE_BYTES).sum())).select("text", "label").collect()
    return [r.text or "" for r in rows], np.array([r.label for r in rows], np.int64)


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch whose first column is doc, a struct of all columns of the documents."""
    doc = batch.column(0)
    return doc.field(doc.type.get_field_index("text"))


def text_batches(batches, at, most: int = TOGETHER):
    """The batches, cut so that each has about `most` bytes of text in column `at`, or in what `at` takes from a batch."""
    for whole in batches:
        _, sizes = utf8(at(whole) if callable(at) else whole.column(at))
        for x, y in slices(sizes, most):
            yield whole.slice(x, y - x)


def code_points(raw: np.ndarray) -> np.ndarray:
    """The number of code points that begin before each byte position, the end included."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
