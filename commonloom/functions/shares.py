"""Splitting values into three shares and opening them again, as column functions.

This shows the algebra only: one session sees all shares, so nothing is kept secret. Additive
shares wrap at 64 bits; sums are taken with decimals modulo 2^64, which holds in ANSI mode too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _power(n: int) -> Column:
    return F.lit(str(1 << n)).cast("decimal(38,0)")


def wrap(value: Column) -> Column:
    """A decimal's two's-complement 64-bit value."""
    low = F.pmod(value.cast("decimal(38,0)"), _power(64))
    return F.when(low >= _power(63), low - _power(64)).otherwise(low).cast("long")


def _wide(x: Column) -> Column:
    return x.cast("decimal(21,0)")


def wrapping_add(a: Column, b: Column) -> Column:
    return wrap(_wide(a) + _wide(b))


def wrapping_subtract(a: Column, b: Column) -> Column:
    return wrap(_wide(a) - _wide(b))


def random_share(seed: int, *row: Column) -> Column:
    """A 64-bit number that looks random, the same whenever a row is computed again."""
    return F.xxhash64(F.lit(seed), *row)


def share_boolean(x: Column, seed: int, *row: Column) -> Column:
    """Three shares whose exclusive or is x. `row`: what tells rows apart."""
    a, b = random_share(seed, *row), random_share(seed + 1, *row)
    return F.struct(a.alias("s1"), b.alias("s2"), x.cast("long").bitwiseXOR(a).bitwiseXOR(b).alias("s3"))


def share_arithmetic(x: Column, seed: int, *row: Column) -> Column:
    """Three shares whose wrapping sum is x."""
    a, b = random_share(seed, *row), random_share(seed + 1, *row)
    return F.struct(a.alias("s1"), b.alias("s2"), wrap(_wide(x.cast("long")) - _wide(a) - _wide(b)).alias("s3"))


def open_boolean(shares: Column) -> Column:
    return shares["s1"].bitwiseXOR(shares["s2"]).bitwiseXOR(shares["s3"])


def open_arithmetic(shares: Column) -> Column:
    return wrap(_wide(shares["s1"]) + _wide(shares["s2"]) + _wide(shares["s3"]))


def random_bit(seed: int, *row: Column) -> tuple[Column, Column]:
    """A random bit in both sharings."""
    bit = random_share(seed, *row).bitwiseAND(1)
    return share_boolean(bit, seed + 2, *row), share_arithmetic(bit, seed + 4, *row)


def add_shares(x: Column, y: Column) -> Column:
    """Additive shares of the sum, share by share."""
    return F.struct(*(wrapping_add(x[s], y[s]).alias(s) for s in ("s1", "s2", "s3")))


def xor_shares(x: Column, y: Column) -> Column:
    return F.struct(*(x[s].bitwiseXOR(y[s]).alias(s) for s in ("s1", "s2", "s3")))


def to_arithmetic(shares: Column, seed: int, *row: Column) -> Column:
    """From exclusive-or shares to additive ones of the same value."""
    return share_arithmetic(open_boolean(shares), seed, *row)


def to_boolean(shares: Column, seed: int, *row: Column) -> Column:
    return share_boolean(open_arithmetic(shares), seed, *row)
