"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every normalised text and fills, in each task, two bit arrays: bits that some hash has set, and bits of
hashes whose bits had all been set before. Arrays of two tasks merge by `twice = t1 | t2 | (o1 & o2)`, `once = o1 | o2`,
which never loses a repeated hash. Pass two tests each row: rows that cannot be repeated pass straight through, the rest
shuffle by their hash. The arrays have 16 bits a row, at most MOST_BITS. A table of more rows is dealt out by ranges of the
hash - digests and places only, never texts - and each range has its own two passes and arrays, so the share of rows that
passes straight through is the same at every size.

Null and empty texts are equal to each other. Of equal texts the largest doc_id stays (null ids are smallest); of rows with
the same id and text the one that lies last (file name, place in the file) stays. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, BooleanType

from tapewright.llm.common import LOWERED, kept, narrow, on_files, placed, table
from tapewright.llm.filters import key_filter, split_possibly
from tapewright.sources.scratch import place

HASHES = 4
BITS_A_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SLICE = 1 << 13  # 64-bit words of an array that travel together
_TABLE = LOWERED.tobytes()


def digest(text: str | None) -> bytes:
    """SHA-256 of the text with A-Z lowered."""
    return hashlib.sha256((text or "").encode().translate(_TABLE)).digest()


@arrow_udf(BinaryType())
def digests(texts: pa.Array) -> pa.Array:
    return pa.array([digest(t) for t in texts.to_pylist()], pa.binary())


def positions(keys: pa.Array, bits: int) -> np.ndarray:
    """The HASHES bit positions of each 32-byte digest."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, HASHES)
    return raw & np.uint64(bits - 1)


def _has(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((array[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=1)


def _put(array: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(array, (at >> np.uint64(6)).ravel(), np.uint64(1) << (at & np.uint64(63)).ravel())


def _filled(bits: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits >> 6, np.uint64), np.zeros(bits >> 6, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            at, n = np.unique(positions(b.column(0), bits), axis=0, return_counts=True)
            again = _has(once, at) | (n > 1)
            _put(twice, at[again])
            _put(once, at)
        yield from _sliced(once, twice)

    return fill


def _sliced(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(once), SLICE):
        o, t = once[k : k + SLICE], twice[k : k + SLICE]
        if o.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "once": [zlib.compress(o.tobytes(), 1)], "twice": [zlib.compress(t.tobytes(), 1)]})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the slices of a task; holds one pair of arrays for each slice number dealt to it."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for k, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (o, t))
            if k in held:
                a, c = held[k]
                t, o = t | c | (o & a), o | a
            held[k] = (o, t)
    for k, (o, t) in held.items():
        if t.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "once": [b""], "twice": [zlib.compress(t.tobytes(), 1)]})


def repeated_filter(digested: DataFrame) -> tuple[np.ndarray, int]:
    """The bits of all possibly repeated digests (column 'digest'). At most MOST_BITS / 8 bytes reach the driver."""
    n = digested.count()
    bits = min(max(LEAST_BITS, 1 << max(0, n * BITS_A_ROW - 1).bit_length()), MOST_BITS)
    schema = "slice int, once binary, twice binary"
    parts = digested.select("digest").mapInArrow(_filled(bits), schema)
    merged = narrow(parts.repartition("slice")).mapInArrow(_merged, schema)
    array = np.zeros(bits >> 6, np.uint64)
    for r in merged.select("slice", "twice").collect():
        part = np.frombuffer(zlib.decompress(bytes(r.twice)), np.uint64)
        array[r.slice * SLICE : r.slice * SLICE + len(part)] = part
    return array, bits


def _tester(spark, array: np.ndarray, bits: int):
    sent = spark.sparkContext.broadcast(array)

    @arrow_udf(BooleanType())
    def possibly(keys: pa.Array) -> pa.Array:
        return pa.array(_has(sent.value, positions(keys, bits)) if len(keys) else [], pa.bool_())

    return possibly


def ranges_for(rows: int) -> int:
    """How many ranges of digests keep 16 bits a row within MOST_BITS."""
    return max(1, -(-rows * BITS_A_ROW // MOST_BITS))


def _tested(rows: DataFrame) -> DataFrame:
    """doc_id, place, digest, and whether the digest is possibly repeated (again)."""
    spark, n = rows.sparkSession, ranges_for(rows.count())
    digested = rows.select(F.col("doc.doc_id").alias("doc_id"), "place", digests("doc.text").alias("digest"))
    if n == 1:
        digested = kept(digested, "digests")
        return digested.withColumn("again", _tester(spark, *repeated_filter(digested))("digest"))
    part = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint") * n, 32).cast("int")
    path, out = place(spark, "digests"), place(spark, "tested")
    with_part = digested.withColumn("part", part)
    with_part.repartition(8 * n, "part", F.crc32(F.substring("digest", 5, 4)) % 8).write.partitionBy("part").parquet(path)
    for i in range(n):
        one = spark.read.schema(with_part.schema).parquet(path).where(F.col("part") == i).drop("part")
        one.withColumn("again", _tester(spark, *repeated_filter(one))("digest")).write.mode("append").parquet(out)
    return spark.read.schema(digested.withColumn("again", F.lit(True)).schema).parquet(out)


def _groups(tested: DataFrame) -> DataFrame:
    """digest, keep (id and place of the row that stays), group_size; of possibly repeated digests."""
    found = tested.where("again").groupBy("digest").agg(F.max(F.struct("doc_id", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return kept(found, "groups")


def decisions(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    tested = _tested(placed(on_files(docs)))
    groups = _groups(tested)
    one = tested.where(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    more = (
        tested.where("again").join(groups, "digest")
        .select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.struct("doc_id", "place").eqNullSafe(F.col("keep")).alias("kept"), "digest")
    )
    return one.unionByName(more).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns. Texts that the filter of rows that go does not know are not shuffled."""
    rows = placed(on_files(docs))
    tested = _tested(rows)
    gone = kept(
        tested.where("again").join(_groups(tested).where("group_size > 1"), "digest")
        .where(~F.struct("doc_id", "place").eqNullSafe(F.col("keep"))).select(F.col("place").alias("gone")),
        "gone",
    )
    some, clear = split_possibly(rows, key_filter(gone.select(F.xxhash64("gone"))), F.xxhash64("place"))
    return clear.select("doc.*").unionByName(some.join(gone, F.col("place") == F.col("gone"), "left_anti").select("doc.*"))


QUERY = "op9_exact_dedup"


def query(spark, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
