"""The functional stream: a chain of operations over elements that builds one DataFrame plan.

Elements are the rows of a one-column DataFrame (`value`), or whole rows. Functions take and give Columns and so stay
in generated code; plain Python functions over pandas batches are possible with `map_batches`.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


class Stream:
    def __init__(self, df: DataFrame, ordered: tuple[Column, ...] = ()):
        self._df, self._ordered = df, ordered
        self._parallel, self._seconds = False, None

    @classmethod
    def of(cls, df: DataFrame, value: str | Column | None = None) -> Stream:
        """Elements are whole rows as structs, or the values of one column."""
        column = F.struct(*df.columns) if value is None else F.col(value) if isinstance(value, str) else value
        return cls(df.select(column.alias("value")))

    @property
    def df(self) -> DataFrame:
        return self._df

    def _value(self) -> Column:
        return F.col("value")

    # intermediate operations
    def filter(self, predicate: Fn) -> Stream:
        return Stream(self._df.filter(predicate(self._value())), self._ordered)

    def map(self, f: Fn) -> Stream:
        return Stream(self._df.select(f(self._value()).alias("value")))

    def map_to_int(self, f: Fn) -> Stream:
        return self.map(lambda v: f(v).cast("int"))

    def map_to_long(self, f: Fn) -> Stream:
        return self.map(lambda v: f(v).cast("long"))

    def map_to_double(self, f: Fn) -> Stream:
        return self.map(lambda v: f(v).cast("double"))

    def map_to_obj(self, f: Fn) -> Stream:
        return self.map(f)

    def as_long(self) -> Stream:
        return self.map(lambda v: v.cast("long"))

    def as_double(self) -> Stream:
        return self.map(lambda v: v.cast("double"))

    def boxed(self) -> Stream:
        return self

    def flat_map(self, f: Fn) -> Stream:
        """f gives an array; its elements become elements."""
        return Stream(self._df.select(F.explode(f(self._value())).alias("value")))

    def flat_map_to_int(self, f: Fn) -> Stream:
        return self.flat_map(lambda v: f(v).cast("array<int>"))

    def flat_map_to_long(self, f: Fn) -> Stream:
        return self.flat_map(lambda v: f(v).cast("array<long>"))

    def flat_map_to_double(self, f: Fn) -> Stream:
        return self.flat_map(lambda v: f(v).cast("array<double>"))

    def map_batches(self, f, schema: str) -> Stream:
        """f maps an iterator of pandas frames to one; schema has one column, `value`."""
        return Stream(self._df.mapInPandas(f, schema))

    def distinct(self) -> Stream:
        return Stream(self._df.distinct())

    def sorted(self, key: Fn | None = None, descending: bool = False) -> Stream:
        """By the element, or by a key first and then the element, so that ties have an order."""
        keys = [key(self._value())] if key else []
        order = [k.desc() if descending else k.asc() for k in [*keys, self._value()]]
        return Stream(self._df.orderBy(*order), tuple(order))

    def limit(self, n: int) -> Stream:
        return Stream(self._df.limit(n), self._ordered)

    def skip(self, n: int) -> Stream:
        return Stream(self._df.offset(n), self._ordered)

    def peek(self, observation: Observation, *metrics: Column) -> Stream:
        """Metrics of the elements that pass here, available on the observation after an action."""
        return Stream(self._df.observe(observation, *metrics), self._ordered)

    def unordered(self) -> Stream:
        return Stream(self._df)

    def filter_keys(self, keys: list, key: Fn) -> Stream:
        return self.filter(lambda v: key(v).isin(keys))

    def filter_key_segments(self, segments: list[int], key: Fn, of: int = 256) -> Stream:
        return self.filter(lambda v: F.pmod(F.xxhash64(key(v)), F.lit(of)).isin(segments))

    # terminal operations
    def count(self) -> DataFrame:
        return self._df.agg(F.count("*").alias("n"))

    def sum(self) -> DataFrame:
        return self._df.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("sum"))

    def average(self) -> DataFrame:
        return self._df.agg(F.avg("value").alias("avg"))

    def min(self) -> DataFrame:
        return self._df.agg(F.min("value").alias("min"))

    def max(self) -> DataFrame:
        return self._df.agg(F.max("value").alias("max"))

    def summary(self) -> DataFrame:
        return self._df.agg(F.count("value").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"))

    def reduce(self, aggregate: Fn) -> DataFrame:
        """An associative reduction as an aggregate function, such as F.sum or F.bit_xor."""
        return self._df.agg(aggregate(self._value()).alias("value"))

    def collect(self, key: Fn, *aggregates: Column) -> DataFrame:
        """groupingBy: aggregates of the elements (column `value`) by key."""
        return self._df.groupBy(key(self._value()).alias("key")).agg(*aggregates)

    def any_match(self, predicate: Fn) -> DataFrame:
        return self._df.agg(F.coalesce(F.bool_or(predicate(self._value())), F.lit(False)).alias("matches"))

    def all_match(self, predicate: Fn) -> DataFrame:
        return self._df.agg(F.coalesce(F.bool_and(predicate(self._value())), F.lit(True)).alias("matches"))

    def none_match(self, predicate: Fn) -> DataFrame:
        return self._df.agg((~F.coalesce(F.bool_or(predicate(self._value())), F.lit(False))).alias("matches"))

    def find_first(self):
        row = self._within(self._df.first)
        return None if row is None else row["value"]

    find_any = find_first

    def iterator(self, prefetch: bool | None = None) -> Iterator:
        """Elements on the driver, a partition at a time; with prefetch (parallel distribution) the next one is computed meanwhile."""
        return (r["value"] for r in self._df.toLocalIterator(prefetchPartitions=self._parallel if prefetch is None else prefetch))

    def batches(self, size: int) -> Iterator[list]:
        """Elements in lists of a size, as the driver takes them."""
        elements = self.iterator()
        while part := list(islice(elements, size)):
            yield part

    def for_each_partition(self, f) -> None:
        self._within(lambda: self._df.foreachPartition(f))

    # how it runs
    def sequential_distribution(self) -> Stream:
        return self._how(parallel=False)

    def parallel_distribution(self) -> Stream:
        return self._how(parallel=True)

    def timeout(self, seconds: float) -> Stream:
        """find_first and for_each_partition raise TimeoutError after so long, and their jobs are cancelled."""
        return self._how(seconds=seconds)

    def split(self, parts: int) -> list[Stream]:
        """Streams that together have each element once, of about equal size: by a hash of the element."""
        place = F.pmod(F.xxhash64(F.col("value")), F.lit(parts))
        return [Stream(self._df.filter(place == k), self._ordered) for k in range(parts)]

    def _how(self, parallel: bool | None = None, seconds: float | None = None) -> Stream:
        out = Stream(self._df, self._ordered)
        out._parallel, out._seconds = self._parallel if parallel is None else parallel, self._seconds if seconds is None else seconds
        return out

    def _within(self, action):
        if self._seconds is None:
            return action()
        context, group = self._df.sparkSession.sparkContext, uuid.uuid4().hex
        context.setJobGroup(group, "stream", interruptOnCancel=True)
        timer = threading.Timer(self._seconds, context.cancelJobGroup, (group,))
        timer.start()
        try:
            return action()
        except Exception as e:
            if not timer.is_alive():
                raise TimeoutError(f"the stream took more than {self._seconds} s") from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
