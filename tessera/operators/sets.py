"""Set commands: on array columns of distinct members, and on DataFrames of (key, member) rows for sets of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.keyspace import glob


def sadd(s: Column, *members) -> Column:
    return F.array_union(s, F.array(*map(F.lit, members)))


def srem(s: Column, *members) -> Column:
    return F.array_except(s, F.array(*map(F.lit, members)))


def scard(s: Column) -> Column:
    return F.when(s.isNull(), 0).otherwise(F.size(s))


def sismember(s: Column, member) -> Column:
    return F.coalesce(F.array_contains(s, member), F.lit(False))


def smismember(s: Column, members: list) -> Column:
    return F.array(*[sismember(s, m) for m in members])


def smembers(s: Column) -> Column:
    return F.array_sort(s)


def smove(source: Column, target: Column, member) -> tuple[Column, Column]:
    return srem(source, member), F.when(sismember(source, member), sadd(target, member)).otherwise(target)


def sscan(s: Column, pattern: str) -> Column:
    regex = glob(pattern)
    return F.filter(s, lambda x: x.rlike(regex))


def spop(s: Column, n: int = 1, seed: int | None = None) -> Column:
    """Random members without repeats; also SRANDMEMBER."""
    return F.slice(F.shuffle(s, seed) if seed is not None else F.shuffle(s), 1, n)


def sunion(*sets: Column) -> Column:
    return F.array_sort(reduce(F.array_union, sets))


def sinter(*sets: Column) -> Column:
    return F.array_sort(reduce(F.array_intersect, sets))


def sdiff(*sets: Column) -> Column:
    return F.array_sort(reduce(F.array_except, sets))


def sintercard(*sets: Column, limit: int = 0) -> Column:
    n = F.size(reduce(F.array_intersect, sets))
    return F.least(n, F.lit(limit)) if limit else n


def members(rows: DataFrame, key: str, member: str) -> DataFrame:
    """SMEMBERS of every key: one array each."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(member))


def union_rows(*rows: DataFrame) -> DataFrame:
    """Sets as one-column DataFrames."""
    return reduce(lambda a, b: a.union(b), rows).distinct()


def inter_rows(*rows: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), rows)


def diff_rows(first: DataFrame, *rows: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.subtract(b), rows, first.distinct())
