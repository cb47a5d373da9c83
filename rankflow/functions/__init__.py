"""Scalar Column helpers (JVM-side expressions only, no Python UDFs).

Each helper reproduces one text or number rule of the ranking study with
built-in Spark functions so that it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Java-style trim removes every char <= U+0020 at both ends.
_CTRL = "".join(chr(i) for i in range(0x21))
# A number as captured by the log rules (digits, dot, E, minus).
NUMBER_PATTERN = r"([0-9\.E-]+)"
# Scale of the integer error counter of the batch rule.
FIXED_POINT_SCALE = 100000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c: Column | str) -> Column:
    """Strip all chars <= U+0020 at both ends (Spark's trim only strips blanks)."""
    return F.btrim(_c(c), F.lit(_CTRL))


def split_ws(c: Column | str) -> Column:
    """trim + split on whitespace runs; an empty line gives ``[""]`` (size 1)."""
    return F.split(java_trim(c), r"\s+")


def split_drop_trailing(c: Column | str, sep: str) -> Column:
    """Split on a literal one-char separator and drop trailing empty fields."""
    esc = "\\" + sep if sep in r".\|()[]{}^$*+?" else sep
    return F.split(F.regexp_replace(_c(c), f"({esc})+$", ""), esc)


def try_double(c: Column | str) -> Column:
    """Parse a double; unparsable or empty text gives null (ANSI-safe)."""
    return F.nullif(_c(c), F.lit("")).try_cast("double")


def capture_number(c: Column | str, label: str) -> Column:
    """First ``<label>\\s*<number>`` match of the line as double, else null."""
    return try_double(F.regexp_extract(_c(c), label + r"\s*" + NUMBER_PATTERN, 1))


def strip_units(c: Column | str) -> Column:
    """Keep digits and dots only, then parse; unparsable gives 0.0 (B1)."""
    return F.coalesce(
        try_double(F.regexp_replace(_c(c), r"[^0-9.]", "")), F.lit(0.0)
    )


def fixed_point(c: Column | str, scale: int = FIXED_POINT_SCALE) -> Column:
    """abs(x) scaled and truncated toward zero to a long (one counter step)."""
    return (F.abs(_c(c)) * F.lit(float(scale))).cast("bigint")


# Width of a bin of ``exact_sum`` and the size up to which it is used.
_BIN = float(2 ** 31)
_BINNED = float(2 ** 32)


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles that is the same for any order and split of the rows.

    Each number is cut into its whole part and two bins of 31 binary places;
    the bins are summed as integers (partial and final aggregates, so no
    rounding and no order) and put together once.  What a number has below
    2^-62 is left out.  Numbers of 2^32 and more, and those that are not
    numbers, are summed as doubles beside them.
    """
    x = _c(c)
    small = F.abs(x) < _BINNED
    v = F.when(small, x)
    whole = F.floor(v)
    first = (v - whole) * F.lit(_BIN)
    second = (first - F.floor(first)) * F.lit(_BIN)
    low = (F.sum(F.floor(first)).cast("double") / F.lit(_BIN)
           + F.sum(F.floor(second)).cast("double") / F.lit(_BIN * _BIN))
    total, rest = F.sum(whole).cast("double") + low, F.sum(F.when(~small, x))
    return F.coalesce(total + rest, total, rest)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den when den > 0 else 0.0."""
    return F.when(_c(den) > 0, _c(num) / _c(den)).otherwise(F.lit(0.0))


def last_position(arr: Column | str, value: str) -> Column:
    """1-based position of the LAST element equal to value, 0 if absent."""
    a = _c(arr)
    p = F.array_position(F.reverse(a), value).cast("int")
    return F.when(p > 0, F.size(a) - p + 1).otherwise(F.lit(0))


def token(arr: Column | str, pos0: Column | int) -> Column:
    """0-based element of an array; null when out of range (ANSI-safe)."""
    p = pos0 if isinstance(pos0, Column) else F.lit(pos0)
    return F.try_element_at(_c(arr), (p + 1).cast("int"))
