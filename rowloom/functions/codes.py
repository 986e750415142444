"""Closed dictionaries and bitmasks as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ordinal that stands for a symbol outside of its dictionary.
UNKNOWN = 65535


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def failed(code: str, detail: Column) -> Column:
    """Raises an error that begins with its code, where the row is evaluated."""
    return F.raise_error(F.concat(F.lit(f"{code}: "), F.coalesce(detail.cast("string"), F.lit("null"))))


def ordinal(symbol: Column, values: Sequence[str], base: int, strict: bool = True) -> Column:
    """Ordinal of a symbol; null for null; beyond the dictionary an error, or UNKNOWN if not strict."""
    at = F.array_position(literals(values), symbol).cast("int")
    beyond = failed("InvalidEnumOrdinal", symbol).cast("int") if strict else F.lit(UNKNOWN)
    return F.when(symbol.isNull(), F.lit(None).cast("int")).when(at > 0, at - 1 + base).otherwise(beyond)


def symbol(ordinal: Column, values: Sequence[str], base: int, strict: bool = True) -> Column:
    """Symbol of an ordinal; null for null; beyond the dictionary an error, or null if not strict."""
    inside = ordinal.between(base, base + len(values) - 1)
    beyond = failed("InvalidEnumOrdinal", ordinal).cast("string") if strict else F.lit(None).cast("string")
    return F.when(ordinal.isNull(), F.lit(None).cast("string")).when(inside, F.get(literals(values), ordinal - base)).otherwise(beyond)


def bit(i: int) -> int:
    """1 << i as a signed long."""
    return -(1 << 63) if i == 63 else 1 << i


def mask_of(symbols: Column, values: Sequence[str]) -> Column:
    """Bitmask of an array of symbols; symbols beyond the dictionary have no bit."""
    out = F.lit(0).cast("long")
    for i, v in enumerate(values):
        out = out.bitwiseOR(F.when(F.array_contains(symbols, v), F.lit(bit(i)).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(symbols.isNull(), F.lit(None).cast("long")).otherwise(out)


def _held(mask: Column, values: Sequence[str]) -> list[Column]:
    """Each symbol, null where its bit is not set."""
    return [F.when(mask.bitwiseAND(F.lit(bit(i)).cast("long")) != 0, F.lit(v)) for i, v in enumerate(values)]


def symbols_of(mask: Column, values: Sequence[str]) -> Column:
    """Symbols of a bitmask, in the order of the dictionary."""
    held = _held(mask, values)
    return F.when(mask.isNotNull(), F.array_compact(F.array(*held)) if held else F.array().cast("array<string>"))


def symbols_text(mask: Column, values: Sequence[str]) -> Column:
    """Symbols of a bitmask as one text with commas between, without an array on the way."""
    return F.when(mask.isNotNull(), F.concat_ws(",", *_held(mask, values)))


def unsigned(value: Column) -> Column:
    """A long's bits as an unsigned decimal number."""
    return F.conv(F.hex(value), 16, 10)


def mask_from_decimal(value: Column) -> Column:
    """The bits of an unsigned number that a reader gave as a decimal."""
    top, whole = F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)")
    return F.when(value >= top, value - whole).otherwise(value).cast("long")
