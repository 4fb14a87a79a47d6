"""Bit filters over 64-bit keys, sized by the number of keys, built by tasks and merged by a small shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from tapewright.llm.common import U64, narrow

BITS_A_KEY = 16
LEAST, MOST = 1 << 16, 1 << 28  # bits: 8 KB to 32 MB; beyond 16 million keys more rows pass, and none is lost
PART = 4096  # bytes that travel together
_SCHEMA = "k int, bits binary"


def positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & U64(bits - 1)).astype(np.int64), ((h >> U64(32)) & U64(bits - 1)).astype(np.int64)


def _mask(p: np.ndarray) -> np.ndarray:
    return np.uint8(1) << (p & 7).astype(np.uint8)


def _parts(held: dict[int, np.ndarray]):
    for k, x in held.items():
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "bits": [x.tobytes()]})


def _filled(bits: int):
    def fill(batches):
        held = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            for p in positions(np.asarray(b.column(0)).view(np.uint64), bits):
                np.bitwise_or.at(held, p >> 3, _mask(p))
        rows = held.reshape(-1, PART)
        yield from _parts({k: rows[k] for k in np.flatnonzero(rows.any(axis=1)).tolist()})

    return fill


def _merge(batches):
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(bits, np.uint8)
            held[k] = held[k] | x if k in held else x
    yield from _parts(held)


def size_for(n: int) -> int:
    """Bits for n keys: a power of two."""
    return min(max(1 << max(0, n * BITS_A_KEY - 1).bit_length(), LEAST), MOST)


def key_filter(keys: DataFrame) -> np.ndarray:
    """The filter of a column of mixed 64-bit hashes without nulls; keys is read twice, so it should lie on disk."""
    bits = size_for(keys.count())
    out = np.zeros((bits // 8 // PART, PART), np.uint8)
    for r in narrow(keys.mapInArrow(_filled(bits), _SCHEMA).repartition("k")).mapInArrow(_merge, _SCHEMA).collect():  # bits / 8 bytes
        out[r.k] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def known(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be among the keys."""
    p, q = positions(h, len(held) * 8)
    return (held[p >> 3] & _mask(p) != 0) & (held[q >> 3] & _mask(q) != 0)


def _tester(df: DataFrame, held: np.ndarray):
    sent = df.sparkSession.sparkContext.broadcast(held)

    @arrow_udf(BooleanType())
    def test(keys: pa.Array) -> pa.Array:
        return pa.array(known(sent.value, np.asarray(keys).view(np.uint64)))

    return test


def possibly(df: DataFrame, held: np.ndarray, key: Column) -> DataFrame:
    """The rows of df whose key may be in the filter."""
    return df.where(_tester(df, held)(key))


def split_possibly(df: DataFrame, held: np.ndarray, key: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be in the filter, and the others."""
    test = _tester(df, held)
    return df.where(test(key)), df.where(~test(key))
