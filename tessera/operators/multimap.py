"""Multimaps, counters and functional maps over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Multimap:
    """Rows of (key, value); duplicates of a pair count only where they are allowed."""

    def __init__(self, df: DataFrame, key: str = "key", value: str = "value", duplicates: bool = False):
        self.df, self.key, self.value, self.duplicates = (df if duplicates else df.dropDuplicates([key, value])), key, value, duplicates

    def put(self, rows: DataFrame) -> Multimap:
        return Multimap(self.df.unionByName(rows), self.key, self.value, self.duplicates)

    def get(self) -> DataFrame:
        """All values of each key."""
        return self.df.groupBy(self.key).agg(F.array_sort(F.collect_list(self.value)).alias("values"))

    def remove(self, key, value=None) -> Multimap:
        gone = F.col(self.key) == key
        gone = gone if value is None else gone & (F.col(self.value) == value)
        return Multimap(self.df.filter(~F.coalesce(gone, F.lit(False))), self.key, self.value, self.duplicates)

    def contains(self, key=None, value=None) -> DataFrame:
        test = F.lit(True)
        test = test if key is None else test & (F.col(self.key) == key)
        test = test if value is None else test & (F.col(self.value) == value)
        return self.df.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("found"))

    def size(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class CounterConfig:
    """A counter's start and, if it is a bounded one, its bounds; both included."""

    initial: int = 0
    lower: int | None = None
    upper: int | None = None

    def __post_init__(self):
        low, high = self.limits()
        if not low <= self.initial <= high:
            raise ValueError("the initial value must lie within the bounds")

    def limits(self) -> tuple[int, int]:
        return (-(1 << 62) if self.lower is None else self.lower), ((1 << 62) if self.upper is None else self.upper)

    @property
    def bounded(self) -> bool:
        return self.lower is not None or self.upper is not None


class CounterManager:
    """Counters by name. Defined ones keep their first configuration; deltas of unknown ones are left out."""

    def __init__(self):
        self._defined: dict[str, CounterConfig] = {}

    def define(self, name: str, config: CounterConfig) -> bool:
        """Whether the counter is new."""
        return self._defined.setdefault(name, config) is config

    def is_defined(self, name: str) -> bool:
        return name in self._defined

    def configuration(self, name: str) -> CounterConfig | None:
        return self._defined.get(name)

    def names(self) -> list[str]:
        return sorted(self._defined)

    def undefine(self, name: str) -> None:
        self._defined.pop(name, None)

    def values(self, deltas: DataFrame, counter: str, delta: str, order: str) -> DataFrame:
        """counter and value of every defined counter after all deltas; without any it is the initial one."""
        kind = deltas.schema[counter].dataType.simpleString()
        known = deltas.sparkSession.createDataFrame([(n, c.initial) for n, c in self._defined.items()], f"{counter} {kind}, _first long")
        folded = _folded(deltas, counter, delta, order, dict(self._defined))
        return known.join(folded, counter, "left").select(counter, _through(F.coalesce("parts", F.array()), F.col("_first")).alias("value"))


def counter_values(deltas: DataFrame, counter: str, delta: str, initial: int = 0, lower: int | None = None, upper: int | None = None, order: str | None = None) -> DataFrame:
    """Values of counters after all deltas. A bounded counter is held at its bounds after every delta, in the order of a column."""
    config = CounterConfig(initial, lower, upper)
    if not config.bounded:
        return deltas.groupBy(counter).agg((F.sum(delta) + initial).cast("long").alias("value"))
    if order is None:
        raise ValueError("a bounded counter needs the order of its deltas")
    return _folded(deltas, counter, delta, order, config).select(counter, _through(F.col("parts"), F.lit(initial).cast("long")).alias("value"))


def _folded(deltas: DataFrame, counter: str, delta: str, order: str, config: CounterConfig | dict[str, CounterConfig]) -> DataFrame:
    """What all deltas of a counter do to any value, as parts in order.

    A stretch of deltas takes v to min(max(v + a, lo), hi), whatever v is: so stretches are folded where they lie after a range
    partitioning by counter and order, which parts a hot counter, and only (a, lo, hi) of each stretch meet.
    """
    limits = {k: c.limits() for k, c in config.items()} if isinstance(config, dict) else None
    same = None if isinstance(config, dict) else config.limits()
    names = [counter, "at", "a", "lo", "hi"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, at, low, high = None, [], 0, 0, 0
        state = (0, 0, 0)
        for frame in frames:
            for k, d in zip(frame[counter].tolist(), frame[delta].tolist(), strict=True):
                if k != held:
                    if at:
                        rows.append((held, at, *state))
                    low, high = same or limits[k]
                    held, state, at = k, (0, low, high), at + 1
                a, lo, hi = state
                state = (a + d, min(max(lo + d, low), high), min(max(hi + d, low), high))
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if at:
            rows.append((held, at, *state))
        yield pd.DataFrame(rows, columns=names)

    kind = deltas.schema[counter].dataType.simpleString()
    rows = deltas.where(F.col(counter).isNotNull()).select(counter, F.coalesce(F.col(delta).cast("long"), F.lit(0)).alias(delta), order)
    rows = rows if limits is None else rows.where(F.col(counter).isin(list(limits)))
    ranged = rows.repartitionByRange(counter, order).sortWithinPartitions(counter, order).select(counter, delta)
    folded = ranged.mapInPandas(fold, f"{counter} {kind}, at long, a long, lo long, hi long").withColumn("part", F.spark_partition_id())
    return folded.groupBy(counter).agg(F.array_sort(F.collect_list(F.struct("part", "at", "a", "lo", "hi"))).alias("parts"))


def _through(parts: Column, initial: Column) -> Column:
    return F.aggregate(parts, initial, lambda v, p: F.least(F.greatest(v + p["a"], p["lo"]), p["hi"]))


def compare_and_swap(value: Column, expected: int, new: int) -> Column:
    """The counter after the swap; the old value is returned by reading the column before."""
    return F.when(value == expected, F.lit(new)).otherwise(value)


class FunctionalMap:
    """eval over keyed entries; f maps a DataFrame of the entries to a DataFrame of results, so it stays in the plan."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def eval(self, key, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return f(self.df.filter(F.col(self.key) == key))

    def eval_many(self, keys: DataFrame | list, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if isinstance(keys, DataFrame):
            return f(self.df.join(keys.select(self.key), self.key, "left_semi"))
        return f(self.df.filter(F.col(self.key).isin(keys)))

    def eval_all(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return f(self.df)

    def keys(self) -> DataFrame:
        return self.df.select(self.key)

    def entries(self) -> DataFrame:
        return self.df

    def write(self, changed: DataFrame) -> FunctionalMap:
        """Entries replaced by key."""
        return FunctionalMap(self.df.join(changed.select(self.key), self.key, "left_anti").unionByName(changed), self.key)

    def truncate(self) -> FunctionalMap:
        return FunctionalMap(self.df.limit(0), self.key)
