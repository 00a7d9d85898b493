"""Sorted sets as DataFrames of (member, score), or (key, member, score) for many of them, ordered by score, then member.

Ranks of many sets are windows over the key. The rank of one member is a count of the rows before it, not a global
sort, and a slice of one set is a top-k; `ranked` on a single set numbers rows within ranges and adds the rows of the
ranges before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.keyspace import glob


class SortedSet:
    def __init__(self, df: DataFrame, member: str = "member", score: str = "score", key: list[str] | None = None):
        self.df, self.member, self.score, self.key = df, member, score, key or []

    def _like(self, df: DataFrame) -> SortedSet:
        return SortedSet(df, self.member, self.score, self.key)

    def _order(self, reverse: bool) -> list[Column]:
        columns = [F.col(self.score), F.col(self.member)]
        return [c.desc() if reverse else c.asc() for c in columns]

    # writes
    def add(self, rows: DataFrame, mode: str = "last") -> SortedSet:
        """ZADD: last (the new score), nx (keep), xx (known members only), gt, lt (the larger or smaller), incr (the sum)."""
        by = [*self.key, self.member]
        tagged = self.df.select(*by, self.score, F.lit(0).alias("_turn")).unionByName(rows.select(*by, self.score, F.lit(1).alias("_turn")))
        if mode == "xx":
            rows = rows.join(self.df.select(*by), by, "left_semi")
            return self.add(rows)
        value = {"last": F.max_by(self.score, "_turn"), "nx": F.min_by(self.score, "_turn"), "gt": F.max(self.score), "lt": F.min(self.score), "incr": F.sum(self.score)}[mode]
        return self._like(tagged.groupBy(*by).agg(value.alias(self.score)))

    def incr_by(self, rows: DataFrame) -> SortedSet:
        return self.add(rows, "incr")

    def rem(self, members: list) -> SortedSet:
        return self._like(self.df.filter(~F.col(self.member).isin(members)))

    def rem_range_by_score(self, low: float, high: float) -> SortedSet:
        return self._like(self.df.filter(~F.col(self.score).between(low, high)))

    def rem_range_by_rank(self, start: int, stop: int) -> SortedSet:
        gone = self.range(start, stop).select(*self.key, self.member)
        return self._like(self.df.join(gone, [*self.key, self.member], "left_anti"))

    def rem_range_by_lex(self, low: str | None, high: str | None) -> SortedSet:
        return self._like(self.df.filter(~_lex(F.col(self.member), low, high)))

    # reads
    def card(self) -> DataFrame:
        return self.df.groupBy(*self.key).agg(F.count("*").alias("n"))

    def count(self, low: float, high: float) -> DataFrame:
        return self.df.filter(F.col(self.score).between(low, high)).groupBy(*self.key).agg(F.count("*").alias("n"))

    def lex_count(self, low: str | None, high: str | None) -> DataFrame:
        return self.df.filter(_lex(F.col(self.member), low, high)).groupBy(*self.key).agg(F.count("*").alias("n"))

    def scores(self, members: list) -> DataFrame:
        """ZSCORE and ZMSCORE; null for members that aren't there."""
        wanted = self.df.sparkSession.createDataFrame([(m,) for m in members], f"{self.member} {self.df.schema[self.member].dataType.simpleString()}")
        return wanted.join(self.df, self.member, "left")

    def ranked(self, reverse: bool = False) -> DataFrame:
        """Every row with its 0-based rank in its set. A single set is dealt into ranges by its order; each range is numbered alone,
        and its start is the sum of the sizes of those before, of which there are as many as partitions."""
        order = self._order(reverse)
        if self.key:
            return self.df.withColumn("rank", F.row_number().over(Window.partitionBy(*self.key).orderBy(*order)) - 1)
        # One quantile pass; the bounds are literals then, so both uses of them agree.
        parts = max(1, int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        scores = self.df.agg(F.percentile_approx(self.score, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
        bounds = sorted(set(scores or []))
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(self.score) > b)) if bounds else F.lit(0)
        ranged = self.df.withColumn("_part", -at if reverse else at)
        sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a range
        numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
        return numbered.join(F.broadcast(starts), "_part").select(*self.df.columns, (F.col("_at") + F.col("_start")).alias("rank"))

    def rank(self, member, reverse: bool = False) -> DataFrame:
        """ZRANK of one member: the number of rows before it."""
        mine = self.df.filter(F.col(self.member) == member).select(*self.key, F.col(self.score).alias("_s"), F.col(self.member).alias("_m"))
        pair, other = F.struct(self.score, self.member), F.struct("_s", "_m")
        joined = self.df.join(F.broadcast(mine), self.key) if self.key else self.df.crossJoin(F.broadcast(mine))  # one row a set
        before = pair > other if reverse else pair < other
        return joined.groupBy(*self.key).agg(F.count_if(before).alias("rank"))

    def range(self, start: int, stop: int, reverse: bool = False) -> DataFrame:
        """ZRANGE by rank, both ends included; negative ranks count from the end."""
        if start >= 0 and stop >= 0 and not self.key:
            return self.df.orderBy(*self._order(reverse)).offset(start).limit(max(0, stop - start + 1))
        if start < 0 and stop < 0 and not self.key:
            return self.df.orderBy(*self._order(not reverse)).offset(-stop - 1).limit(max(0, stop - start + 1)).orderBy(*self._order(reverse))
        n = F.count("*").over(Window.partitionBy(*(self.key or [F.lit(0)])))
        first = n + start if start < 0 else F.lit(start)
        last = n + stop if stop < 0 else F.lit(stop)
        return self.ranked(reverse).withColumn("_in", F.col("rank").between(first, last)).filter("_in").drop("_in", "rank")

    def range_by_score(self, low: float, high: float, offset: int = 0, limit: int | None = None, reverse: bool = False) -> DataFrame:
        out = self.df.filter(F.col(self.score).between(low, high)).orderBy(*self._order(reverse))
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def range_by_lex(self, low: str | None, high: str | None, offset: int = 0, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """Bounds start with [ or ( as in the command; null is open."""
        out = self.df.filter(_lex(F.col(self.member), low, high)).orderBy(F.col(self.member).desc() if reverse else F.col(self.member).asc())
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def pop(self, n: int = 1, largest: bool = False) -> tuple[DataFrame, SortedSet]:
        """ZPOPMIN, ZPOPMAX and ZMPOP: the n taken from each set, and what stays."""
        taken = self.ranked(largest).filter(F.col("rank") < n).drop("rank") if self.key else self.df.orderBy(*self._order(largest)).limit(n)
        return taken, self._like(self.df.join(taken.select(*self.key, self.member), [*self.key, self.member], "left_anti"))

    def scan(self, pattern: str) -> DataFrame:
        return self.df.filter(F.col(self.member).rlike(glob(pattern)))

    def random(self, n: int = 1) -> DataFrame:
        return self.df.orderBy(F.rand()).limit(n)

    # of several sets
    def union(self, *others: SortedSet, weights: list[float] | None = None, aggregate: str = "sum") -> SortedSet:
        weights = weights or [1.0] * (1 + len(others))
        parts = [s.df.select(F.col(s.member).alias(self.member), (F.col(s.score) * w).alias(self.score)) for s, w in zip((self, *others), weights, strict=True)]
        merged = reduce(lambda a, b: a.unionByName(b), parts)
        return SortedSet(merged.groupBy(self.member).agg(_AGGREGATE[aggregate](self.score).alias(self.score)), self.member, self.score)

    def inter(self, *others: SortedSet, weights: list[float] | None = None, aggregate: str = "sum") -> SortedSet:
        """One aggregation: members that as many sets hold as there are."""
        weights = weights or [1.0] * (1 + len(others))
        parts = [s.df.select(F.col(s.member).alias(self.member), (F.col(s.score) * w).alias(self.score)) for s, w in zip((self, *others), weights, strict=True)]
        merged = reduce(lambda a, b: a.unionByName(b), parts).groupBy(self.member).agg(_AGGREGATE[aggregate](self.score).alias(self.score), F.count("*").alias("_n"))
        return SortedSet(merged.filter(F.col("_n") == len(parts)).drop("_n"), self.member, self.score)

    def inter_card(self, *others: SortedSet, limit: int = 0) -> DataFrame:
        found = self.inter(*others).df
        return (found.limit(limit) if limit else found).agg(F.count("*").alias("n"))

    def diff(self, *others: SortedSet) -> SortedSet:
        out = self.df
        for s in others:
            out = out.join(s.df.select(F.col(s.member).alias(self.member)), self.member, "left_anti")
        return self._like(out)


_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def _lex(c: Column, low: str | None, high: str | None) -> Column:
    test = F.lit(True)
    if low not in (None, "-"):
        test = test & (c >= low[1:] if low[0] == "[" else c > low[1:])
    if high not in (None, "+"):
        test = test & (c <= high[1:] if high[0] == "[" else c < high[1:])
    return test
