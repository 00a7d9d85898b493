"""List commands on array columns; places are 0-based and negative ones count from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def llen(a: Column) -> Column:
    return F.when(a.isNull(), 0).otherwise(F.size(a))


def lindex(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def lrange(a: Column, start: int, end: int) -> Column:
    """Also SUBLIST and LTRIM: the elements from start to end."""
    size = F.size(a)
    first = F.greatest(size + start, F.lit(0)) if start < 0 else F.lit(start)
    last = size + end if end < 0 else F.least(F.lit(end), size - 1)
    return F.slice(a, first + 1, F.greatest(last - first + 1, F.lit(0)))


ltrim = lrange


def lpush(a: Column, *values) -> Column:
    """Each in turn becomes the head."""
    for v in values:
        a = F.array_prepend(a, _lit(v))
    return a


def rpush(a: Column, *values) -> Column:
    for v in values:
        a = F.array_append(a, _lit(v))
    return a


def lpushx(a: Column, *values) -> Column:
    return F.when(llen(a) > 0, lpush(a, *values)).otherwise(a)


def rpushx(a: Column, *values) -> Column:
    return F.when(llen(a) > 0, rpush(a, *values)).otherwise(a)


def lpop(a: Column, n: int = 1) -> tuple[Column, Column]:
    """What is taken from the head, and what stays."""
    return F.slice(a, 1, n), lrange(a, n, -1)


def rpop(a: Column, n: int = 1) -> tuple[Column, Column]:
    """Taken from the tail, last first."""
    stay = F.greatest(F.size(a) - n, F.lit(0))
    return F.reverse(F.slice(a, stay + 1, F.greatest(F.size(a) - stay, F.lit(0)))), F.slice(a, F.lit(1), stay)


def lmpop(arrays: list[Column], n: int = 1, left: bool = True) -> Column:
    """From the first of the lists that isn't empty."""
    out = F.lit(None)
    for a in reversed(arrays):
        out = F.when(llen(a) > 0, (lpop if left else rpop)(a, n)[0]).otherwise(out)
    return out


def lmove(source: Column, target: Column, from_left: bool, to_left: bool) -> tuple[Column, Column]:
    """Both lists after one element has moved; RPOPLPUSH is (False, True)."""
    taken, rest = lpop(source) if from_left else rpop(source)
    moved = F.get(taken, 0)
    return rest, F.when(F.size(source) > 0, lpush(target, moved) if to_left else rpush(target, moved)).otherwise(target)


def lset(a: Column, i: int, value) -> Column:
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.transform(a, lambda x, k: F.when(k == at, _lit(value)).otherwise(x))


def linsert(a: Column, pivot, value, before: bool = True) -> Column:
    """Beside the first pivot; unchanged without one."""
    at = F.array_position(a, pivot)
    k = at - 1 if before else at
    return F.when(at == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), k.cast("int")), F.array(_lit(value)), F.slice(a, (k + 1).cast("int"), F.size(a))))


def lrem(a: Column, n: int, value) -> Column:
    """The first n equal ones go (the last -n if negative, all if 0)."""
    if n == 0:
        return F.filter(a, lambda x: ~x.eqNullSafe(_lit(value)))
    if n < 0:
        return F.reverse(lrem(F.reverse(a), -n, value))
    places = F.slice(F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(_lit(value)), i)), lambda i: i.isNotNull()), 1, n)
    return F.filter(a, lambda x, i: ~F.array_contains(places, i))


def lpos(a: Column, value, rank: int = 1) -> Column:
    """Where the rank-th equal element stands (from the end if negative), null if there is none."""
    places = F.filter(F.transform(a, lambda x, i: F.when(x == _lit(value), i)), lambda i: i.isNotNull())
    return F.get(places, F.lit(rank - 1) if rank > 0 else F.size(places) + rank)


def lpos_all(a: Column, value) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(x == _lit(value), i)), lambda i: i.isNotNull())


def rotate(a: Column, left: bool = False) -> Column:
    """The last element becomes the first, or the first the last."""
    moved = F.concat(lrange(a, 1, -1), F.slice(a, 1, 1)) if left else F.concat(F.slice(a, -1, 1), lrange(a, 0, -2))
    return F.when(F.size(a) > 1, moved).otherwise(a)
