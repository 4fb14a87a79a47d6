"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Each code point gets a class from a table; class and lookahead give a symbol; a symbol is a transition function of a
small automaton. The composition of such functions is associative, and only a few dozen functions arise, so their
products are a table and the state before every code point comes from a blocked prefix scan over arrays - no regex.
A piece begins where the automaton says so; slices of the UTF-8 bytes go to pair merging, whose results are cached.

Null texts are empty and have no tokens. Rows keep their other columns. Texts are treated whole; the ids and the byte
offset of each pre-token are returned, so ids decode without the text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tapewright.llm.common import slices, table, utf8

END, LETTER, NUMBER, OTHER, BLANK, SPACE = range(6)
# The code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Symbols: what one code point does, given the one or two after it.
S_END, S_LETTER, S_NUMBER, S_OTHER, S_MID, S_BLANK, S_SPACE, S_TICK1, S_TICK2 = range(9)
# States: what the code points so far have left open.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, JOINS, ONE_MORE, TWO_MORE = range(8)
CACHED, CACHED_BYTES = 1 << 19, 64
LONG = 1 << 20  # characters
INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    out[0x20] = BLANK
    return out


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this code point."""
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_MID: IN_SPACES}
    if symbol == S_LETTER and state == TWO_MORE:
        return ONE_MORE, False
    if symbol == S_LETTER and state == ONE_MORE:
        return NEW, False
    if symbol in (S_TICK1, S_TICK2):
        if state not in (IN_OTHERS, JOINS):
            return (ONE_MORE if symbol == S_TICK1 else TWO_MORE), True
        symbol = S_OTHER
    if symbol in run:
        return run[symbol], state != run[symbol] and not (state == JOINS and symbol != S_MID)
    return (JOINS if symbol == S_BLANK else NEW), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, product table, state after each function from each state, whether a piece begins)."""
    states, symbols = range(8), range(9)
    found = {tuple(step(s, x)[0] for s in states): None for x in symbols}
    first = list(found)
    while True:
        new = {tuple(b[a[s]] for s in states) for a in found for b in first} - found.keys()
        if not new:
            break
        found |= dict.fromkeys(sorted(new))
    place = {f: i for i, f in enumerate(found)}
    product = np.array([[place[tuple(b[a[s]] for s in states)] for b in found] for a in found], np.uint8)
    of = np.array([place[tuple(step(s, x)[0] for s in states)] for x in symbols], np.uint8)
    begins = np.array([[step(s, x)[1] for x in symbols] for s in states])
    return of, product, np.array(list(found), np.uint8), begins


def states_before(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The state before each symbol, by a prefix scan of transition functions: within blocks, over blocks, and applied."""
    of, product, after, _ = automaton()
    n, k = len(symbols), len(product)
    flat = product.ravel()
    columns = -(-n // block)
    f = np.full(columns * block, of[S_END], np.uint8)
    f[:n] = of[symbols]
    f = np.ascontiguousarray(f.reshape(columns, block).T)
    for r in range(1, block):
        f[r] = flat[f[r - 1].astype(np.uint16) * k + f[r]]
    enter = np.zeros(columns, np.uint8)
    state = NEW
    for c, g in enumerate(f[-1].tolist()):
        enter[c] = state
        state = int(after[g, state])
    out = np.empty((block, columns), np.uint8)
    out[0] = enter
    flat = after.ravel()
    out[1:] = flat[f[:-1].astype(np.uint16) * 8 + enter]
    return out.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin, as indices into points; and the class array. ends: indices of the separators between texts."""
    kind = classes()[points]
    kind[ends] = END
    after = np.zeros_like(kind)
    after[:-1] = kind[1:]
    symbol = np.array([S_END, S_LETTER, S_NUMBER, S_OTHER, S_MID, S_MID], np.uint8)[kind]
    last = (after == LETTER) | (after == NUMBER) | (after == OTHER)
    symbol[(kind == BLANK) & last] = S_BLANK
    symbol[(kind == SPACE) & last] = S_SPACE
    for i in np.flatnonzero((points == 0x27) & (kind == OTHER)).tolist():
        for c in CONTRACTIONS:
            if points[i + 1 : i + 1 + len(c)].tolist() == [ord(x) for x in c] and END not in kind[i + 1 : i + 1 + len(c)]:
                symbol[i] = S_TICK1 if len(c) == 1 else S_TICK2
                break
    begins = automaton()[3]
    return np.flatnonzero(begins.ravel()[states_before(symbol).astype(np.uint16) * 9 + symbol]), kind


class Merger(dict):
    """Piece of bytes -> its ids as packed little-endian 32-bit integers. Emptied when it has `most` entries."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHED):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()  # at most `most` pieces of CACHED_BYTES bytes
        out = np.array([self.ranks[p] for p in self.merged(piece)], "<u4").tobytes()
        if len(piece) <= CACHED_BYTES:
            self[piece] = out
        return out

    def merged(self, piece: bytes) -> list[bytes]:
        """Joins the adjacent pair of least rank, the leftmost of equals, until none has a rank."""
        if piece in self.ranks:
            return [piece]
        if len(piece) > 200:
            return self._long(piece)
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while rank and (least := min(rank)) < none:
            i = rank.index(least)
            parts[i] += parts.pop(i + 1)
            rank.pop(i)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], none)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _long(self, piece: bytes) -> list[bytes]:
        """The same with a heap, for pieces where rescanning would be quadratic."""
        n, get = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop or not alive[j]:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [piece[i : end[i]] for i in range(n) if alive[i]]


@functools.lru_cache(maxsize=2)
def merger(raw: bytes) -> Merger:
    return Merger({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})


@functools.lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> list[bytes]:
    ranks = merger(raw).ranks
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def pieces_of(texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The pre-tokens of each text, and their byte offsets in it."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths + 1) - 1
    starts, _ = piece_starts(points, ends)
    at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])[starts]
    raw = joined.encode()
    bounds = np.searchsorted(starts, ends)  # a separator is a piece by itself
    a = 0
    for b in bounds.tolist():
        cut = at[a : b + 1]
        edges = cut.tolist()
        yield [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)], cut[:-1] - cut[0]
        a = b + 1


def stretches(text: str) -> Iterator[str]:
    """A long text in parts of about LONG characters that can be cut into pieces each by itself.

    Between a character that is no white space and a blank with another such character behind it a piece always begins."""
    a = 0
    while len(text) - a > 2 * LONG and (cut := INNER_BLANK.search(text, a + LONG)):
        yield text[a : cut.start()]
        a = cut.start()
    yield text[a:]


def _encoded(text: str, get) -> tuple[bytes, np.ndarray]:
    """The packed ids of a text, and the byte offsets of its pieces."""
    ids, offsets, base = [], [], 0
    for part in stretches(text):
        for pieces, at in pieces_of([part]):
            ids.append(b"".join(map(get, pieces)))
            offsets.append(at + base)
            base += sum(map(len, pieces))
    return b"".join(ids), np.concatenate(offsets)


def encoded(batches: Iterator[pa.RecordBatch], raw: bytes, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Each batch with the columns ids and offsets instead of the text."""
    get = merger(raw).__getitem__
    for b in batches:
        i = b.schema.get_field_index(text)
        _, sizes = utf8(b.column(i))
        for x, y in slices(sizes):
            part = b.slice(x, y - x)
            ids, offsets = [], []
            texts = [t or "" for t in part.column(i).to_pylist()]
            if len(texts) == 1 and len(texts[0]) > 2 * LONG:
                found = [_encoded(texts[0], get)]
            else:
                found = ((b"".join(map(get, pieces)), at) for pieces, at in pieces_of(texts))
            for packed, at in found:
                ids.append(packed)
                offsets.append(at.astype(np.int32))
            bounds = np.cumsum([0, *(len(v) // 4 for v in ids)]).astype(np.int32)
            arrays = {f.name: c for k, (f, c) in enumerate(zip(part.schema, part.columns, strict=True)) if k != i}
            arrays["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            cuts = np.cumsum([0, *map(len, offsets)]).astype(np.int32)
            arrays["offsets"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(offsets) if offsets else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def decoded(ids: np.ndarray, raw: bytes) -> bytes:
    return b"".join(map(vocabulary(raw).__getitem__, ids.tolist()))


def digested(batches: Iterator[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    """Encoded batches -> doc_id, number of ids, digests of the ids and of the bytes they decode to."""
    for b in batches:
        lists = b.column(b.schema.get_field_index("ids"))
        flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets)
        each = [flat[x:y] for x, y in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column(b.schema.get_field_index("doc_id")),
            "n_tokens": pa.array([len(v) for v in each], pa.int64()),
            "ids_sha256": [hashlib.sha256(v.astype("<u4").tobytes()).hexdigest() for v in each],
            "decoded_sha256": [hashlib.sha256(decoded(v, raw)).hexdigest() for v in each],
        })


def load(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and sent to the tasks. It is a file of fixed size, under 2 MB."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids and offsets (of the pre-tokens, in bytes) instead of the text."""
    sent = load(docs.sparkSession, path)
    fields = [f for f in docs.schema if f.name not in (text, "ids", "offsets")]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in fields]

    def run(batches):
        for b in encoded(batches, sent.value, text):
            yield b.select([*names, "ids", "offsets"])

    return docs.select(*(f"`{n}`" for n in names), f"`{text}`").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded, then decoded from the ids."""
    sent = load(docs.sparkSession, path)

    def run(batches):
        return digested(encoded(batches, sent.value), sent.value)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERY = "op6_byte_bpe"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
