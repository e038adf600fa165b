"""Column algebra by name, over BIGINT columns; with ordinary SQL meaning for signs and nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int


def _column(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


ARITHMETIC: dict[str, Callable[[Number, Number], Column]] = {
    "add": lambda a, b: _column(a) + _column(b),
    "subtract": lambda a, b: _column(a) - _column(b),
    "multiply": lambda a, b: _column(a) * _column(b),
    "divide": lambda a, b: _column(a) / _column(b),
}

COMPARISONS: dict[str, Callable[[Number, Number], Column]] = {
    "eq": lambda a, b: _column(a) == _column(b),
    "ne": lambda a, b: _column(a) != _column(b),
    "gt": lambda a, b: _column(a) > _column(b),
    "ge": lambda a, b: _column(a) >= _column(b),
    "lt": lambda a, b: _column(a) < _column(b),
    "le": lambda a, b: _column(a) <= _column(b),
}

BITWISE: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: a.bitwiseAND(b),
    "or": lambda a, b: a.bitwiseOR(b),
    "xor": lambda a, b: a.bitwiseXOR(b),
}


def negate(a: Column) -> Column:
    return -a


def bitwise_not(a: Column) -> Column:
    return F.bitwise_not(a)


def flip(a: Column) -> Column:
    """The other value of a 0/1 column."""
    return a.bitwiseXOR(F.lit(1).cast("long"))


def as_number(bit: Column) -> Column:
    """A boolean as 0 or 1."""
    return bit.cast("long")


def equals_zero(a: Column) -> Column:
    return a == 0


def above_zero(a: Column) -> Column:
    return a > 0


def at_least_zero(a: Column) -> Column:
    return a >= 0


def below_zero(a: Column) -> Column:
    return a < 0


def get_bit(a: Column, at: int) -> Column:
    return F.getbit(a, F.lit(at))


def set_bit(a: Column, at: int) -> Column:
    return a.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), at))


def unset_bit(a: Column, at: int) -> Column:
    return a.bitwiseAND(F.bitwise_not(F.shiftleft(F.lit(1).cast("long"), at)))


def unset_low_bits(a: Column, n: int) -> Column:
    """The lowest n bits cleared."""
    return F.shiftleft(F.shiftright(a, n), n) if n < 64 else F.lit(0).cast("long")


def all_bits(a: Column) -> Column:
    """Aggregate: the AND of all values of a group."""
    return F.bit_and(a)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)
