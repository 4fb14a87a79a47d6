"""Alignment of the tokens of two tokenizers on the same texts, by runs along the diagonal.

Both tokenizers read a blank and the text (the second adds the blank itself). Byte offsets where a token of each ends cut the
two sequences into groups. Within a text:

1. Runs. While the ends of both agree at the present index shift, slices of 1, 2, 4, ... ends are compared at once, and the
   last slice that differs is halved, so a stretch of one-to-one tokens costs the logarithm of its length.
2. Irregular groups. Where ends differ, the token that ends first is passed until both end together; the pairs met on the way
   are the links of the group, and the shift is what it is after it.

How often the corpus links two ids is counted from the distinct pairs of blocks of texts (BLOCK bytes, or one longer text);
each block gets the counts of its own pairs back, so neither texts nor tokens meet at a pair, and no table of all pairs is
sent anywhere.

The first tokenizer is the byte-level vocabulary of a JSON file: its merges are in the order of its ids (checked), so the rank
engine gives its ids; the second is a sentence-piece model. Texts of over bpe.LONG characters go through both in parts that are
cut at single blanks between other characters: there a token of both always begins.

Null and empty texts have no tokens, nor have texts whose tokens do not join to a blank and the text (a model may normalise):
all numbers are 0 and groups are ''. Rows with equal ids are rows of their own. Other columns stay in `doc`.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.bpe import stretches
from tapewright.llm.common import kept, table, text_batches

BLOCK = 1 << 20  # bytes of text whose pairs are counted together


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The tokenizer of a byte-level JSON file: bytes of each id, and the ids of a text."""

    def __init__(self, raw: bytes):
        import public_tokenizers
        import tiktoken

        file = json.loads(raw)
        of, special = _byte_of(), {t["id"] for t in file["added_tokens"]}
        ids: dict[str, int] = file["model"]["vocab"]
        ranks = {bytes(map(of.__getitem__, w)): i for w, i in ids.items() if i not in special}
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges are not in the order of their ids")
        self.bytes = [b""] * (max(ids.values()) + 1)
        for w, i in ranks.items():
            self.bytes[i] = w
        self._engine = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._engine.encode_ordinary(text)


class Pieces:
    """The tokenizer of a sentence-piece model, which puts a blank before a text."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self._engine = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = map(self._engine.id_to_piece, range(self._engine.get_piece_size()))
        self.bytes = [bytes([int(p[3:5], 16)]) if self._engine.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self._engine.encode(text, num_threads=1)


@functools.lru_cache(4)
def _tokenizers(a: bytes, b: bytes) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


class Groups:
    """What aligning one text in parts has found: groups as text, and the indices of linked tokens."""

    def __init__(self, text: bool = False):
        self.n = 0
        self.digest = hashlib.sha256()
        self.text: list[str] | None = [] if text else None

    def _say(self, x: bytes) -> None:
        self.digest.update(x)
        if self.text is not None:
            self.text.append(x.decode())

    def add(self, ends: tuple[Sequence[int], Sequence[int]], ids: tuple[Sequence[int], Sequence[int]], names: tuple[Sequence, Sequence]) -> tuple[np.ndarray, np.ndarray]:
        """Aligns a part, given by where its tokens end and by their ids (the last ends agree); the ids of its links.

        The loop notes, for each irregular group, the tokens met and the run behind it; runs are written out at once afterwards."""
        ends_a, ends_b = ends
        i = j = 0
        n, m = len(ends_a), len(ends_b)
        last_a, last_b, length = [], [], []  # a group's last tokens, and how many groups end there and one by one behind
        met_a, met_b = [], []
        while i < n:
            x, y, a, b = i, j, ends_a[i], ends_b[j]
            while a != b:
                met_a.append(x)
                met_b.append(y)
                if a < b:
                    x += 1
                    a = ends_a[x]
                else:
                    y += 1
                    b = ends_b[y]
            met_a.append(x)
            met_b.append(y)
            last_a.append(x)
            last_b.append(y)
            i, j = x + 1, y + 1
            if i < n and j < m and ends_a[i] == ends_b[j]:
                i, j, step = i + 1, j + 1, 2
                while i + step <= n and j + step <= m and ends_a[i : i + step] == ends_b[j : j + step]:
                    i, j, step = i + step, j + step, 2 * step
                while step > 1:
                    step >>= 1
                    if i + step <= n and j + step <= m and ends_a[i : i + step] == ends_b[j : j + step]:
                        i, j = i + step, j + step
            length.append(i - x)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        counts = np.array(length)
        since = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        last = [np.repeat(k, counts) + since for k in (last_a, last_b)]
        run = since > 0
        ids = [np.asarray(k, np.int32) for k in ids]
        self._say(_written(last, ids, [np.asarray(k, "S8") for k in names], bool(self.n)))
        self.n += len(since)
        return tuple(k[np.concatenate([met, at[run]])] for k, met, at in zip(ids, (met_a, met_b), last, strict=True))


def _written(last: list[np.ndarray], ids: list[np.ndarray], names: list[np.ndarray], more: bool) -> bytes:
    """Groups as text (`a1,a2|b1;a3|b2,b3`), after a `;` if there are more before: each token goes to its place as name and sign."""
    (a, b), (n_a, n_b) = last, (np.diff(k, prepend=-1) for k in last)
    at = np.arange(len(ids[0])) + np.repeat(b + 1 - n_b, n_a), np.arange(len(ids[1])) + np.repeat(a + 1, n_b)
    out = np.zeros(len(ids[0]) + len(ids[1]), "<i8")  # up to seven digits, and the sign in the last byte
    for places, ends, sign, of, name in zip(at, last, "|;", ids, names, strict=True):
        words = name.view("<i8")[of] + (ord(",") << 56)
        words[ends] += ord(sign) - ord(",") << 56
        out[places] = words
    return (b";" if more else b"") + out.tobytes().translate(None, b"\0")[:-1]


class Aligner:
    """Aligns texts by two tokenizers."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = _tokenizers(a, b)
        self.sizes = [np.array([len(x) for x in t.bytes]) for t in (self.a, self.b)]
        self.names = tuple(np.array([str(i) for i in range(len(t.bytes))], "S8") for t in (self.a, self.b))
        if len(self.a.bytes) * len(self.b.bytes) >= 1 << 31 or max(map(len, self.sizes)) > 10**7:
            raise ValueError("vocabularies too large for pairs of 31 bits or ids of 7 digits")

    def of(self, text: str | None, groups: bool) -> tuple[int, int, int, str, str | None, np.ndarray]:
        """n_a, n_b, n_groups, digest of the groups, their text, and the pair (a * size of b + b) of each link."""
        found, pairs, n_a, n_b = Groups(groups), [], 0, 0
        for k, part in enumerate(stretches(" " + text) if text else ()):
            raw = part.encode()
            a, b = self.a.encode(part), self.b.encode(part[1:])
            if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
                return 0, 0, 0, "", "" if groups else None, np.zeros(0, np.int32)
            ids = tuple(np.frombuffer(array("i", k), np.int32) for k in (a, b))
            ends = tuple(array("i", np.cumsum(size[k], dtype=np.int32).tobytes()) for size, k in zip(self.sizes, ids, strict=True))
            x, y = found.add(ends, ids, self.names)
            pairs.append(x * np.int32(len(self.b.bytes)) + y)
            n_a, n_b = n_a + len(a), n_b + len(b)
        if not pairs:
            return 0, 0, 0, "", "" if groups else None, np.zeros(0, np.int32)
        return n_a, n_b, found.n, found.digest.hexdigest(), "".join(found.text) if groups else None, np.concatenate(pairs)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _aligned(sent_a, sent_b, groups: bool, block: int):
    """doc, text -> for each block of texts a row for each text and one row, without doc, of the distinct pairs of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(sent_a.value, sent_b.value), count()
        for b in text_batches(batches, 1, block):
            rows, own = [], []
            for t in b.column(1):
                *row, pairs = aligner.of(t.as_py(), groups)
                rows.append((*row, len(pairs)))
                own.append(np.unique(pairs, return_counts=True))
            rows.append((0, 0, 0, "", None, 0))
            pairs = np.concatenate([p for p, _ in own])
            all_pairs, at = np.unique(pairs, return_inverse=True)
            total = np.bincount(at, np.concatenate([c for _, c in own]), len(all_pairs)).astype(np.int64)
            n = len(rows)
            doc = pa.concat_arrays([b.column(0), pa.nulls(1, b.column(0).type)])
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 32 | next(number)] * n, pa.int64()), pa.array([True] * (n - 1) + [False]), doc,
                *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[5] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.string()),
                _lists([*(p for p, _ in own), all_pairs], pa.int32()), _lists([*(c for _, c in own), total], pa.int64()),
            ], ["block", "is_doc", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"])

    return run


def _weighed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of one block with the counts of the block's pairs -> n_best and count_sum of each text."""
    pair, total, best = (np.asarray(counts.column(k).combine_chunks()) for k in ("pair", "total", "best"))
    order = np.argsort(pair)
    pair, total, best = pair[order], total[order], best[order]
    docs = docs.combine_chunks()
    pairs, times = (docs.column(k).combine_chunks() for k in ("pairs", "times"))
    at = np.searchsorted(pair, np.asarray(pairs.flatten()))
    n, rows = np.asarray(times.flatten()), np.repeat(np.arange(docs.num_rows), np.asarray(pairs.value_lengths()))
    sums = [np.zeros(docs.num_rows, np.int64) for _ in range(2)]
    if len(at):
        np.add.at(sums[0], rows, n * best[at])
        np.add.at(sums[1], rows, n * total[at])
    out = docs.select(["doc", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
    return out.append_column("groups_sha256", docs.column("groups_sha256")).append_column("groups", docs.column("groups"))


def align(docs: DataFrame, a: bytes, b: bytes, groups: bool = False, block: int = BLOCK) -> DataFrame:
    """For each row of docs: doc (its columns but the text), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    a, b: the contents of the two vocabulary files (a few MB, sent to the tasks). groups is null unless asked for."""
    sc = docs.sparkSession.sparkContext
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(doc.alias("doc"), F.col("text"))
    schema = f"block long, is_doc boolean, doc {rows.schema['doc'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<int>, times array<long>"
    found = kept(rows.mapInArrow(_aligned(sc.broadcast(a), sc.broadcast(b), groups, block), schema), "aligned", "zstd")
    size = len(_tokenizers(a, b)[1].bytes)
    blocks = found.where("not is_doc").select(F.col("block").alias("of"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("of", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    totals = blocks.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = kept(totals.withColumn("b", F.col("pair") % size), "pairs")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    totals = totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))
    counts = blocks.select("of", "pair").join(totals, "pair")
    out = f"doc {rows.schema['doc'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    return found.where("is_doc").groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_weighed, out)


QUERY = "op13_alignment"


def files() -> tuple[bytes, bytes]:
    """The two vocabulary files that the query takes."""
    import public_tokenizers

    return tuple(open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents").select("doc_id", "text"), *files())
    return out.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
