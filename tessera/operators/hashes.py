"""Hash commands on map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.keyspace import glob


def hget(m: Column, field: str) -> Column:
    return F.element_at(m, F.lit(field))


def hmget(m: Column, fields: list[str]) -> Column:
    return F.array(*[hget(m, f) for f in fields])


def hexists(m: Column, field: str) -> Column:
    return F.coalesce(F.map_contains_key(m, field), F.lit(False))


def hset(m: Column, entries: dict, keep: bool = False) -> Column:
    """Set fields; keep leaves those that are there (HSETNX). Fields come in order: old ones, then new."""
    new = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.lit(v))])
    return F.map_zip_with(m, new, lambda k, old, fresh: F.coalesce(old, fresh) if keep else F.coalesce(fresh, old))


def hsetnx(m: Column, field: str, value) -> Column:
    return hset(m, {field: value}, keep=True)


def hdel(m: Column, fields: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(fields))


def hgetall(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def hkeys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def hvals(m: Column) -> Column:
    return F.map_values(m)


def hlen(m: Column) -> Column:
    return F.when(m.isNull(), 0).otherwise(F.size(m))


def hincrby(m: Column, field: str, n) -> Column:
    """Also HINCRBYFLOAT; a missing field counts as 0."""
    return F.map_zip_with(m, F.create_map(F.lit(field), F.lit(n)), lambda k, old, add: F.when(add.isNull(), old).otherwise(F.coalesce(old, F.lit(0)) + add))


def hstrlen(m: Column, field: str) -> Column:
    return F.coalesce(F.octet_length(hget(m, field).cast("string")), F.lit(0))


def hscan(m: Column, pattern: str) -> Column:
    regex = glob(pattern)
    return F.map_filter(m, lambda k, v: k.rlike(regex))


def hrandfield(m: Column, n: int = 1) -> Column:
    return F.slice(F.shuffle(F.map_keys(m)), 1, n)
