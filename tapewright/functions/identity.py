"""Stable ids: FNV-1a entity ids and order ids in UUID form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash, as two halves.
OFFSET_HI, OFFSET_LO = 0xCBF29CE4, 0x84222325
PRIME_HI, PRIME_LO = 0x100, 0x1B3
_M32 = 0xFFFFFFFF


def _step(acc: Column, byte: Column) -> Column:
    """(h xor byte) * prime modulo 2**64, in halves of 32 bits so that nothing overflows."""
    lo, hi = acc["lo"].bitwiseXOR(byte), acc["hi"]
    low = lo * PRIME_LO
    high = hi * PRIME_LO + lo * PRIME_HI + F.shiftrightunsigned(low, 32)
    return F.struct(high.bitwiseAND(F.lit(_M32)).alias("hi"), low.bitwiseAND(F.lit(_M32)).alias("lo"))


def fnv1a(text: Column, first_byte: Column) -> Column:
    """FNV-1a over a leading byte and the UTF-8 bytes of text, as a signed 64-bit integer."""
    start = F.struct(F.lit(OFFSET_HI).cast("bigint").alias("hi"), F.lit(OFFSET_LO).cast("bigint").alias("lo"))
    octets = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))
    h = F.aggregate(F.concat(F.array(first_byte.cast("bigint")), octets), start, _step)
    hi = F.when(h["hi"] >= 1 << 31, h["hi"] - (1 << 32)).otherwise(h["hi"])
    return hi * (1 << 32) + h["lo"]


def entity_id(source: Column, ticker: Column) -> Column:
    """Id of (source number, ticker); zero is never used: the prime stands for it."""
    h = fnv1a(ticker, source)
    return F.when(h == 0, F.lit((PRIME_HI << 32) | PRIME_LO)).otherwise(h)


def client_order_id(ts_ns: Column, strategy: Column, seq: Column) -> Column:
    """UUID text of the 64-bit time, the 8-bit strategy and the low 56 bits of the sequence."""
    a = F.lpad(F.lower(F.hex(ts_ns.cast("bigint"))), 16, "0")
    b = F.concat(F.lpad(F.lower(F.hex(strategy.cast("bigint").bitwiseAND(F.lit(0xFF)))), 2, "0"), F.lpad(F.lower(F.hex(seq.cast("bigint").bitwiseAND(F.lit((1 << 56) - 1)))), 14, "0"))
    return F.concat_ws("-", F.substring(a, 1, 8), F.substring(a, 9, 4), F.substring(a, 13, 4), F.substring(b, 1, 4), F.substring(b, 5, 12))
