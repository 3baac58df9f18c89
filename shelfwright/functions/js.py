"""Text and number rules of the source records: truthiness, white space, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space in the wide sense (Unicode), which plain trim and \s do not cover.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once and named, however often the body uses it.

    Expressions are trees: without this, a large value used n times is planned and run n times.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def first_nonempty(*arrays: Column) -> Column:
    """The first of the arrays that has elements; null when none has."""
    return F.get(F.filter(F.array(*arrays), lambda a: F.size(a) > 0), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(c: Column) -> Column:
    """Trim and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_truthy(c: Column, dtype: T.DataType) -> Column:
    """Null, '', 0, NaN and false are not truthy."""
    if isinstance(dtype, T.StringType):
        test = c != ""
    elif isinstance(dtype, T.BooleanType):
        test = c
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        test = (c != 0) & ~F.isnan(c)
    elif isinstance(dtype, T.NumericType):
        test = c != 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def first_truthy(*cols: Column, default: str | None = None) -> Column:
    """First text that is neither null nor empty."""
    candidates = [blank_to_null(c) for c in cols]
    if default is not None:
        candidates.append(F.lit(default))
    return F.coalesce(*candidates) if candidates else F.lit(None).cast("string")


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5) on the binary double."""
    return F.floor(c + F.lit(0.5)).cast("double")


def cents(c: Column) -> Column:
    return F.floor(c * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def number_text(c: Column) -> Column:
    """A double as its shortest plain text: 100 not 100.0, and no exponent."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    plain = c.cast("string").try_cast("decimal(38,18)").cast("string")
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(
        F.regexp_replace(plain, r"\.?0+$", "")
    )


def iso_utc(c: Column) -> Column:
    """Timestamp as ISO text with milliseconds and Z; the session runs in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fixed_percent(part: Column, whole: Column) -> Column:
    """'12.34%', or '0%' when there is nothing to divide by."""
    return F.when(
        whole > 0, F.format_string("%.2f%%", F.try_divide(part, whole) * F.lit(100.0))
    ).otherwise(F.lit("0%"))


def distinct_by(arr: Column, key) -> Column:
    """Elements of ``arr`` whose ``key`` did not occur earlier, in order."""

    def kept(a: Column) -> Column:
        return let(
            F.transform(a, lambda x: key(x)),
            lambda keys: F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1),
        )

    return let(arr, kept)


def last_wins_map(entries: Column) -> Column:
    """Map from key/value structs; the last value of a repeated key counts."""

    def kept(es: Column) -> Column:
        return let(
            F.reverse(F.transform(es, lambda e: e["key"])),
            lambda keys: F.filter(
                es, lambda e, i: F.array_position(keys, e["key"]) == F.size(es) - i
            ),
        )

    return F.map_from_entries(let(entries, kept))
