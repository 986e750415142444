"""Text of values as row formats spell them, in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import failed


def utc(ms: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of epoch milliseconds; milliseconds are dropped towards the past."""
    seconds = F.floor((ms - F.pmod(ms, F.lit(1000).cast("long"))) / 1000)
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("+"))  # years beyond 9999


def base64(data: Column) -> Column:
    """Standard alphabet, padded, without line breaks whatever the session says."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def _escaped(text: Column, short: bool) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    names = SHORT if short else {}
    controls = out
    for c in range(32):
        controls = F.replace(controls, F.lit(chr(c)), F.lit(f"\\{names[c]}" if c in names else f"\\u{c:04x}"))
    return F.when(out.rlike("[\\x00-\\x1f]"), controls).otherwise(out)


SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def json_literal(value: str, short: bool = True) -> str:
    """What json_string makes of a constant; without short, what stands in arrays in CSV cells."""
    out = value.replace("\\", "\\\\").replace('"', '\\"')
    return '"' + "".join((f"\\{SHORT[ord(c)]}" if short and ord(c) in SHORT else f"\\u{ord(c):04x}") if c < " " else c for c in out) + '"'


def json_string(text: Column) -> Column:
    """A JSON string: short escapes where there are any, other controls as lower-case \\u00xx."""
    return F.concat(F.lit('"'), _escaped(text, True), F.lit('"'))


def csv_string(text: Column) -> Column:
    """A CSV cell, always quoted; quotes are doubled and nothing else changes."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_array_string(text: Column) -> Column:
    """A string inside an array in a CSV cell: JSON escapes, all controls as \\u00xx, quotes doubled."""
    return F.replace(F.concat(F.lit('"'), _escaped(text, False), F.lit('"')), F.lit('"'), F.lit('""'))


def integer(value: Column) -> Column:
    return value.cast("string")


def boolean(value: Column) -> Column:
    return F.when(value.isNotNull(), F.when(value, F.lit("true")).otherwise(F.lit("false")))


def number(value: Column, single: bool = False) -> Column:
    """A finite float in plain digits: the fewest that give the same float, no exponent, no trailing .0.

    Of two shortest texts that are equally near the one farther from zero is taken, as format_string rounds.
    Whole numbers that the float holds exactly go through integers. The rest starts from the platform's text, which has
    all digits that are needed; where a shorter rounding gives the same float, that is taken.
    """
    kind, enough = ("float", 6) if single else ("double", 15)
    long_text = value.cast("string")
    n_digits = F.length(F.regexp_replace(long_text, r"E.*|[^0-9]", ""))
    # the smallest floats have few bits, and the platform's text may have a digit too many there as well
    tiny = (F.abs(value) < F.lit(1e-37 if single else 1e-307).cast(kind)) & (value != 0)
    roundings = F.transform(F.sequence(F.lit(0), F.lit(enough + 1)), lambda d: F.call_function("format_string", F.concat(F.lit("%."), d, F.lit("e")), value.cast("double")))
    same = F.filter(roundings, lambda r: r.cast(kind) == value)
    fewest = F.regexp_replace(F.coalesce(F.get(same, F.lit(0)), long_text), r"^(-?\d)e", "$1.0e")
    text = F.when(tiny | (n_digits > enough), fewest).otherwise(long_text)
    plain = F.when(text.rlike("[eE]"), _without_exponent(text)).otherwise(F.regexp_replace(text, r"\.0$", ""))
    whole = (value == F.floor(value.cast("double")).cast(kind)) & (F.abs(value) < F.lit(float(1 << (24 if single else 53))).cast(kind))
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")).cast(kind))
    # a fraction of few digits is the platform's text as it stands
    brief = (F.length(long_text) <= enough + 1) & ~F.contains(long_text, F.lit("E"))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(~finite, failed("NonFiniteNumeric", long_text).cast("string"))
        .when(value == 0, F.when(F.startswith(long_text, F.lit("-")), F.lit("-0")).otherwise(F.lit("0")))
        .when(whole, value.cast("long").cast("string"))
        .when(brief, long_text)
        .otherwise(plain)
    )


def _without_exponent(text: Column) -> Column:
    """d.dddE+-n in plain digits."""
    form = r"^(-?)(\d)\.(\d+)[eE]([+-]?\d+)$"
    sign, power = F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 4).cast("int")
    digits = F.regexp_replace(F.concat(F.regexp_extract(text, form, 2), F.regexp_extract(text, form, 3)), "0+$", "")
    point = power + 1
    n = F.length(digits)
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    return F.concat(sign, body)
