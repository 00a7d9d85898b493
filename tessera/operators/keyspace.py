"""Keyed entries: a DataFrame of (key, value) with an optional expires_at; every command gives a new DataFrame or a lookup.

Writes are unions in which the last row of a key counts, so many of them cost one shuffle on the key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def glob(pattern: str) -> str:
    """An anchored regular expression of a glob with *, ?, [..] and backslash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out.append(pattern[i : end + 1])
            i = end
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


class Keyspace:
    def __init__(self, df: DataFrame, key: str = "key", value: str = "value"):
        self.df, self.key, self.value = df, key, value

    def _like(self, df: DataFrame) -> Keyspace:
        return Keyspace(df, self.key, self.value)

    def _rows(self, entries) -> DataFrame:
        """entries: a DataFrame with the same key and value columns, or a dict."""
        if isinstance(entries, DataFrame):
            return entries
        kinds = {f.name: f.dataType.simpleString() for f in self.df.schema.fields}
        return self.df.sparkSession.createDataFrame(list(entries.items()), f"{self.key} {kinds[self.key]}, {self.value} {kinds[self.value]}")

    # reads
    def get(self, key) -> DataFrame:
        return self.df.filter(F.col(self.key) == key).select(self.value)

    def mget(self, keys: list | DataFrame) -> DataFrame:
        """A value, or null, for each key asked for."""
        wanted = keys if isinstance(keys, DataFrame) else self.df.sparkSession.createDataFrame([(k,) for k in keys], f"{self.key} {self.df.schema[self.key].dataType.simpleString()}")
        return wanted.join(self.df.select(self.key, self.value), self.key, "left")

    def exists(self, keys: list) -> DataFrame:
        """How many of the keys exist, repeats counted; also TOUCH."""
        wanted = self.df.sparkSession.createDataFrame([(k,) for k in keys], f"{self.key} {self.df.schema[self.key].dataType.simpleString()}")
        return wanted.join(self.df, self.key, "left_semi").agg(F.count("*").alias("n"))

    touch = exists

    def keys(self, pattern: str = "*") -> DataFrame:
        return self.df.filter(F.col(self.key).cast("string").rlike(glob(pattern))).select(self.key)

    scan = keys

    def scan_page(self, after=None, count: int = 10, pattern: str = "*") -> DataFrame:
        """SCAN with a cursor: the next keys in order after the last one seen (None at the start); fewer than count end the scan."""
        found = self.keys(pattern)
        found = found if after is None else found.filter(F.col(self.key) > after)
        return found.orderBy(self.key).limit(count)

    def random_key(self) -> DataFrame:
        return self.df.select(self.key).orderBy(F.rand()).limit(1)

    def type(self) -> DataFrame:
        return self.df.select(self.key, F.typeof(self.value).alias("type"))

    def sort(self, by: Column | None = None, offset: int = 0, limit: int | None = None, get: list[Column] | None = None, descending: bool = False, alpha: bool = False) -> DataFrame:
        """SORT_RO over the values: by number, or by text with alpha."""
        key = by if by is not None else F.col(self.value)
        key = key.cast("string") if alpha else key.cast("double")
        out = self.df.orderBy(key.desc() if descending else key.asc(), F.col(self.key)).select(*(get or [F.col(self.value)]))
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    # writes
    def set(self, entries, mode: str = "always") -> Keyspace:
        """SET and MSET; mode nx keeps what is there, xx changes only that. Of entries with one key that of the largest value counts,
        since rows have no order; name an order column `_at` in entries to have the last."""
        new = self._rows(entries)
        tagged = self.df.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
        whole = Window.partitionBy(self.key)
        first = mode == "nx"
        if "_at" not in tagged.columns:
            tagged = tagged.withColumn("_at", F.lit(0))
        order = whole.orderBy(F.col("_turn").asc() if first else F.col("_turn").desc(), F.desc_nulls_last("_at"), F.desc(self.value))
        kept = tagged.withColumn("_old", F.min("_turn").over(whole)).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
        if mode == "xx":
            kept = kept.filter("_old = 0")
        return self._like(kept.drop("_turn", "_old", "_rank", "_at"))

    def setnx(self, entries) -> Keyspace:
        return self.set(entries, "nx")

    def msetnx(self, entries) -> Keyspace:
        """All of them, or none if any exists."""
        new = self._rows(entries)
        taken = new.join(self.df, self.key, "left_semi").limit(1).count()
        return self if taken else self.set(new)

    def delete(self, keys: list) -> Keyspace:
        return self._like(self.df.filter(~F.coalesce(F.col(self.key).isin(keys), F.lit(False))))

    def delete_if(self, key, equals) -> Keyspace:
        """DELEX with IFEQ."""
        return self._like(self.df.filter(~F.coalesce((F.col(self.key) == key) & (F.col(self.value) == equals), F.lit(False))))

    def getdel(self, key) -> tuple[DataFrame, Keyspace]:
        return self.get(key), self.delete([key])

    def getset(self, key, value) -> tuple[DataFrame, Keyspace]:
        return self.get(key), self.set({key: value})

    def rename(self, old, new, only_free: bool = False) -> Keyspace:
        """RENAME; with only_free, RENAMENX. A key that doesn't exist is an error, as in the command."""
        if not self.df.filter(F.col(self.key) == old).limit(1).count():
            raise KeyError(f"no such key: {old!r}")
        if only_free and self.df.filter(F.col(self.key) == new).limit(1).count():
            return self
        rest = self.df if old == new else self.df.filter(F.col(self.key) != new)
        return self._like(rest.withColumn(self.key, F.when(F.col(self.key) == old, F.lit(new)).otherwise(F.col(self.key))))

    # expiry
    def _expiring(self) -> DataFrame:
        return self.df if "expires_at" in self.df.columns else self.df.withColumn("expires_at", F.lit(None).cast("timestamp"))

    def expire(self, keys: list, at: Column) -> Keyspace:
        """EXPIREAT and its kin: at is a timestamp."""
        df = self._expiring()
        return self._like(df.withColumn("expires_at", F.when(F.col(self.key).isin(keys), at).otherwise(F.col("expires_at"))))

    def persist(self, keys: list) -> Keyspace:
        return self.expire(keys, F.lit(None).cast("timestamp"))

    def setex(self, entries, at: Column) -> Keyspace:
        """SETEX and PSETEX: set entries that expire at a timestamp."""
        new = self._rows(entries).withColumn("expires_at", at.cast("timestamp"))
        return self._like(self._expiring()).set(new)

    def getex(self, key, at: Column | None = None, persist: bool = False) -> tuple[DataFrame, Keyspace]:
        """GETEX: the value, and the keyspace in which the key expires at a timestamp, or never with persist."""
        return self.get(key), self.persist([key]) if persist else self if at is None else self.expire([key], at)

    def alive(self, now: Column) -> Keyspace:
        df = self._expiring()
        return self._like(df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)))

    def ttl(self, now: Column, unit: str = "s") -> DataFrame:
        """Time left, -1 without an expiry; unit s or ms."""
        left = F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
        per = {"s": 1_000_000, "ms": 1_000}[unit]
        return self._expiring().select(self.key, F.coalesce(F.floor((left + per // 2) / per), F.lit(-1)).cast("long").alias("ttl"))

    def expire_time(self, unit: str = "s") -> DataFrame:
        per = {"s": 1_000_000, "ms": 1_000}[unit]
        return self._expiring().select(self.key, F.coalesce(F.floor(F.unix_micros(F.col("expires_at").cast("timestamp")) / per), F.lit(-1)).cast("long").alias("at"))
