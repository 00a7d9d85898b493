"""String commands as column expressions. Ranges are 0-based with both ends included; negative places count from the end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX, MIN = (1 << 63) - 1, -(1 << 63)


def append(value: Column, suffix) -> Column:
    return F.concat(F.coalesce(value, F.lit("")), suffix if isinstance(suffix, Column) else F.lit(suffix))


def incr_by(value: Column, n: int = 1) -> Column:
    """value + n for whole numbers; missing counts as 0, a number beyond 64 bits or another string is an error."""
    number = F.coalesce(value, F.lit("0")).cast("string")
    total = number.try_cast("decimal(38,0)") + F.lit(n).cast("decimal(38,0)")
    whole = number.rlike(r"^-?\d{1,19}$")
    fits = whole & total.between(MIN, MAX)
    return F.when(fits, total.cast("long")).otherwise(F.raise_error(F.when(whole, F.lit("increment or decrement would overflow")).otherwise(F.lit("value is not an integer or out of range"))).cast("long"))


def decr_by(value: Column, n: int = 1) -> Column:
    return incr_by(value, -n)


def incr_by_float(value: Column, x: float) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(float(x))


def _bounds(size: Column, start: int, end: int) -> tuple[Column, Column]:
    first = F.greatest(size + start, F.lit(0)) if start < 0 else F.lit(start)
    last = size + end if end < 0 else F.least(F.lit(end), size - 1)
    return first, last


def get_range(value: Column, start: int, end: int) -> Column:
    """Also SUBSTR."""
    text = F.coalesce(value, F.lit(""))
    first, last = _bounds(F.char_length(text), start, end)
    return F.when(last < first, F.lit("")).otherwise(F.substring(text, (first + 1).cast("int"), (last - first + 1).cast("int")))


def set_range(value: Column, offset: int, patch: str) -> Column:
    """patch written at offset; the gap before it is filled with zero characters."""
    text = F.rpad(F.coalesce(value, F.lit("")), F.greatest(F.char_length(F.coalesce(value, F.lit(""))), F.lit(offset)), F.lit("\0"))
    return F.overlay(text, F.lit(patch), F.lit(offset + 1)) if patch else F.coalesce(value, F.lit(""))


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def lcs(a: Column, b: Column) -> Column:
    """The longest common subsequence, in Arrow batches; of several, the one whose elements stand last in b."""

    @F.pandas_udf("string")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_lcs(x or "", y or "") for x, y in zip(xs, ys, strict=True)])

    return run(a, b)


def lcs_len(a: Column, b: Column) -> Column:
    return F.char_length(lcs(a, b))


def _lcs(x: str, y: str) -> str:
    """A row of the table is one integer: bit j is set where the length grows at y[j]; so a row takes a few operations."""
    masks: dict[str, int] = {}
    for j, d in enumerate(y):
        masks[d] = masks.get(d, 0) | 1 << j
    whole = (1 << len(y)) - 1
    rest, grows = whole, [0]
    for c in x:
        match = rest & masks.get(c, 0)
        rest = (rest + match | rest - match) & whole
        grows.append(whole & ~rest)
    size = lambda i, j: (grows[i] & (1 << j) - 1).bit_count()
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(x[i - 1])
            i, j = i - 1, j - 1
        elif size(i - 1, j) > size(i, j - 1):
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def digest(value: Column) -> Column:
    """64-bit XXH3 in hexadecimal; Spark has no such function, so Arrow batches go through the xxhash library."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda v: None if v is None else xxhash.xxh3_64_hexdigest(v.encode()))

    return run(value)
