"""Sketches: HyperLogLog and top-k are Spark's own; count-min, Bloom and cuckoo filters are built from partial sketches.

A partial sketch is made in each input partition and the partials are merged by key, so a build moves one sketch per
partition, never the items. Sketch sizes are fixed by their parameters.

Estimates are what the sketches say. Where exact rows are wanted an exact check follows them: pf_settle, CountMin.settle,
Bloom.confirm, Cuckoo.settle. All but the first count or look up only what the sketch can't answer for sure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# HyperLogLog
def pf_add(df: DataFrame, item: str, *keys: str, lg_k: int = 12) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_agg(item, lg_k).alias("sketch"))


def pf_merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def pf_count(sketch: str | Column = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def pf_settle(sketches: DataFrame, df: DataFrame, item: str, *keys: str, lg_k: int = 12) -> DataFrame:
    """keys, estimate and n, the exact count of df's distinct items; an estimate beyond six standard errors of it is an error."""
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count_distinct(item).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or [F.lit(True)]
    near = F.abs(F.col("estimate") - F.col("_n")) <= 1 + 6 * 1.04 / math.sqrt(1 << lg_k) * F.col("_n")
    n = F.when(near, F.col("_n")).otherwise(F.raise_error(F.lit("a sketch's estimate is beyond its error")).cast("long"))
    return sketches.select(*keys, pf_count().alias("estimate")).join(counts, same).select(*keys, "estimate", n.alias("n"))


# Top-k
def topk_reserve(df: DataFrame, item: str, *keys: str, tracked: int = 10_000) -> DataFrame:
    """TOPK.RESERVE, ADD and INCRBY: an accumulated sketch."""
    return df.groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate({item}, {tracked})").alias("sketch"))


def topk_list(sketches: DataFrame, k: int) -> DataFrame:
    """TOPK.LIST WITHCOUNT: items with counts, most frequent first."""
    rows = sketches.select(*[c for c in sketches.columns if c != "sketch"], F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("x"))
    return rows.select(*[c for c in sketches.columns if c != "sketch"], "x.item", "x.count")


def topk_query(sketches: DataFrame, k: int, items: list) -> DataFrame:
    """TOPK.QUERY and COUNT: whether each item is listed, and its count there."""
    listed = topk_list(sketches, k)
    wanted = sketches.sparkSession.createDataFrame([(i,) for i in items], f"item {listed.schema['item'].dataType.simpleString()}")
    return wanted.join(listed, "item", "left").select("item", F.col("count").isNotNull().alias("listed"), F.coalesce("count", F.lit(0)).alias("count"))


def topk_info(sketches: DataFrame, k: int) -> DataFrame:
    """TOPK.INFO: how many items are listed for a k, and the sum of their counts."""
    rest = [c for c in sketches.columns if c != "sketch"]
    return topk_list(sketches, k).groupBy(*rest).agg(F.lit(k).alias("k"), F.count("*").alias("items"), F.sum("count").alias("total"))


def topk_incr_by(df: DataFrame, item: str, by: str, *keys: str, tracked: int = 10_000) -> DataFrame:
    """TOPK.INCRBY: increments are summed by item first, and the sketch keeps the items of the largest sums."""
    sums = df.groupBy(*keys, item).agg(F.sum(by).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("count"), item)) if keys else None
    if rank is None:
        return sums.orderBy(F.desc("count"), item).limit(tracked).withColumnRenamed(item, "item")
    return sums.withColumn("_rank", rank).where(F.col("_rank") <= tracked).drop("_rank").withColumnRenamed(item, "item")


def topk_exact(df: DataFrame, item: str, k: int) -> DataFrame:
    return df.groupBy(item).agg(F.count("*").alias("count")).orderBy(F.desc("count"), item).limit(k)


# Hashing of the filters below
def hash_pair(item: Column) -> list[Column]:
    """Two 64-bit hashes of the item as text; everything else about an item follows from them."""
    text = item.cast("string")
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(0x5BD1E995), text).alias("_h2")]


def _u(s: pd.Series) -> np.ndarray:
    return s.to_numpy().astype(np.int64).view(np.uint64)


class CountMin:
    """Row r counts an item in column |h1 + r * h2| mod width; an estimate is the least over the rows."""

    def __init__(self, width: int, depth: int):
        self.width, self.depth = width, depth

    @classmethod
    def by_probability(cls, error: float, probability: float) -> CountMin:
        return cls(math.ceil(2 / error), math.ceil(math.log(probability) / math.log(0.5)))

    def cells(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            place = (h1[None, :] + np.arange(self.depth, dtype=np.uint64)[:, None] * h2[None, :]) % np.uint64(self.width)
        return place.astype(np.int64) + np.arange(self.depth)[:, None] * self.width

    def build(self, df: DataFrame, item: str, by: str | None = None) -> DataFrame:
        """One row: counters (array<long>) and total; by is a column of increments."""
        me = self

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table, total = np.zeros(me.width * me.depth, np.int64), 0
            for f in frames:
                cells, n = me.cells(_u(f["_h1"]), _u(f["_h2"])), f["_n"].to_numpy()
                for row in cells:
                    np.add.at(table, row, n)
                total += int(n.sum())
            yield pd.DataFrame({"counters": [table.tolist()], "total": [total]})

        rows = df.select(*hash_pair(F.col(item)), (F.col(by) if by else F.lit(1)).cast("long").alias("_n"))
        return self.merge(rows.mapInPandas(partial, "counters array<long>, total long"))

    def merge(self, sketches: DataFrame, weight: Column | None = None) -> DataFrame:
        """Cell by cell sums, weighted: CMS.MERGE. The total goes along as one more cell."""
        w = weight if weight is not None else F.lit(1)
        cells = sketches.select(F.posexplode(F.concat(F.array("total"), "counters")).alias("i", "c"), w.alias("w"))
        whole = _in_order(cells.groupBy("i").agg(F.sum(F.col("c") * F.col("w")).cast("long").alias("c")))
        return whole.select(F.slice("c", 2, self.width * self.depth).alias("counters"), F.get("c", 0).alias("total"))

    def query(self, sketch: DataFrame, items: DataFrame, item: str) -> DataFrame:
        """Estimates for items. The sketch is one row of a size that its parameters fix; it is read here and broadcast."""
        me, row = self, sketch.select("counters").first()
        held = items.sparkSession.sparkContext.broadcast(np.asarray(row[0], np.int64))

        @F.pandas_udf("long")
        def least(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(held.value[me.cells(_u(h1), _u(h2))].min(0))

        return items.select(item, least(*hash_pair(F.col(item))).alias("estimate"))

    def settle(self, estimates: DataFrame, df: DataFrame, item: str, by: str | None = None) -> DataFrame:
        """estimates (item, estimate) of a sketch of df made exact. An item alone in one of its cells has its true count there, so
        in the least; a sketch in which every item counts once shows which are. Only items that are alone nowhere are counted."""
        once = self.build(df.select(item).union(estimates.select(item)).distinct(), item)
        doubted = self.query(once, estimates.select(item).distinct(), item).where("estimate > 1").select(F.col(item).alias("_item"))
        same = F.col(item).eqNullSafe(F.col("_item"))
        true = doubted.join(df.select(item, (F.col(by) if by else F.lit(1)).cast("long").alias("_n")), same, "left").groupBy("_item")
        true = true.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_true"))
        return estimates.join(true, same, "left").select(item, F.coalesce("_true", "estimate").alias("estimate"))

    def info(self, sketch: DataFrame) -> DataFrame:
        """CMS.INFO: width, depth and the sum of all increments."""
        return sketch.select(F.lit(self.width).alias("width"), F.lit(self.depth).alias("depth"), F.col("total").alias("count"))


def _in_order(cells: DataFrame) -> DataFrame:
    """Rows (i, c) as one array c in order of i; as long as a sketch's parameters say."""
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("c"))


class Bloom:
    """A bit array of m bits and k probes for a capacity and an error rate; never a false negative within any count of items."""

    def __init__(self, capacity: int, error: float = 0.01):
        self.capacity, self.error = capacity, error
        self.bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2 / 64) * 64)
        self.probes = max(1, round(self.bits / capacity * math.log(2)))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h1[None, :] + np.arange(self.probes, dtype=np.uint64)[:, None] * (h2[None, :] | np.uint64(1))) % np.uint64(self.bits)).astype(np.int64)

    def build(self, df: DataFrame, item: str) -> DataFrame:
        """One row: the filter as 64-bit words."""
        me = self

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits = np.zeros(me.bits, bool)
            for f in frames:
                bits[me.places(_u(f["_h1"]), _u(f["_h2"])).ravel()] = True
            yield pd.DataFrame({"filter": [np.packbits(bits, bitorder="little").view(np.int64).tolist()]})

        return self.merge(df.where(F.col(item).isNotNull()).select(*hash_pair(F.col(item))).mapInPandas(partial, "filter array<long>"))

    def merge(self, filters: DataFrame) -> DataFrame:
        """The union, word by word, so that no task holds all filters."""
        words = filters.select(F.posexplode("filter").alias("i", "c"))
        return _in_order(words.groupBy("i").agg(F.bit_or("c").alias("c"))).withColumnRenamed("c", "filter")

    def contains(self, bloom: DataFrame, items: DataFrame, item: str) -> DataFrame:
        """found for every item. The filter is one row of a size that its parameters fix; it is read here and broadcast."""
        me, row = self, bloom.select("filter").first()
        held = items.sparkSession.sparkContext.broadcast(np.asarray(row[0], np.int64).view(np.uint8))

        @F.pandas_udf("boolean")
        def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
            places = me.places(_u(h1), _u(h2))
            return pd.Series((held.value[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool).all(0))

        return items.select(item, test(*hash_pair(F.col(item))).alias("found"))

    def confirm(self, found: DataFrame, item: str, members: DataFrame, member: str) -> DataFrame:
        """found (item, found) with false positives taken back: what the filter found is looked up among the members."""
        there = members.where(F.col(member).isNotNull()).select(F.col(member).alias("_member")).distinct()
        return found.join(there, F.col("found") & (F.col(item) == F.col("_member")), "left").select(item, F.col("_member").isNotNull().alias("found"))

    def card(self, bloom: DataFrame) -> DataFrame:
        """The number of items by the share of set bits."""
        ones = F.aggregate("filter", F.lit(0), lambda n, word: n + F.bit_count(word))
        return bloom.select(F.round(-F.lit(self.bits / self.probes) * F.log(1 - ones / F.lit(self.bits))).cast("long").alias("n"))

    def info(self) -> dict:
        return {"capacity": self.capacity, "size": self.bits // 8, "probes": self.probes, "error_rate": self.error}


class Cuckoo:
    """Fingerprints of 16 bits in two possible buckets each; supports deletion.

    One table holds a bounded number of items. An item that finds no place opens another table of `expansion` times the
    buckets (CF.RESERVE's EXPANSION), so no item is ever lost; a filter is its tables one after the other.
    """

    SHARD_ITEMS, PROBED = 1_000_000, 100_000

    def __init__(self, capacity: int, bucket: int = 4, max_moves: int = 500, expansion: int = 2):
        if expansion < 1 or expansion & (expansion - 1):
            raise ValueError("expansion must be a power of two")
        self.bucket, self.max_moves, self.expansion = bucket, max_moves, expansion
        self.buckets = 1 << max(1, math.ceil(math.log2(capacity / bucket / 0.9)))
        self.capacity = capacity

    def _place(self, table: np.ndarray, h1: int, h2: int) -> tuple[int, int, int]:
        mark = (h2 & 0xFFFF) or 1
        first = h1 % len(table)
        return mark, first, self.other(table, first, mark)

    def other(self, table: np.ndarray, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995) & (len(table) - 1))

    def _free(self, table: np.ndarray, mark: int, *places: int) -> bool:
        for place in places:
            free = np.flatnonzero(table[place] == 0)
            if len(free):
                table[place, free[0]] = mark
                return True
        return False

    def insert(self, table: np.ndarray, h1: int, h2: int) -> bool:
        """Whether the item found a place; if not, the table is as it was before."""
        mark, a, b = self._place(table, h1, h2)
        if self._free(table, mark, a, b):
            return True
        place, moved = a, []
        for move in range(self.max_moves):
            slot = move % self.bucket
            moved.append((place, slot, int(table[place, slot])))
            table[place, slot] = mark
            mark = moved[-1][2]
            place = self.other(table, place, mark)
            if self._free(table, mark, place):
                return True
        for place, slot, mark in reversed(moved):
            table[place, slot] = mark
        return False

    def add(self, tables: list[np.ndarray], h1: int, h2: int) -> None:
        """Inserts into a free slot of any table, newest first, then by moves in the newest, then into a new table."""
        for table in reversed(tables):
            if self._free(table, *self._place(table, h1, h2)):
                return
        if not tables or not self.insert(tables[-1], h1, h2):
            tables.append(np.zeros((self.buckets * self.expansion ** len(tables), self.bucket), np.uint16))
            self.insert(tables[-1], h1, h2)

    def tables(self, data: bytes) -> list[np.ndarray]:
        """The tables of a filter."""
        slots, out, at = np.frombuffer(data, np.uint16).reshape(-1, self.bucket), [], 0
        while at < len(slots):
            size = self.buckets * self.expansion ** len(out)
            out.append(slots[at : at + size])
            at += size
        return out

    def count(self, table: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many marks in a table match each of many items."""
        mark = (h2 & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = (h1 % np.uint64(len(table))).astype(np.int64)
        second = first ^ ((mark * 0x5BD1E995) & (len(table) - 1))
        here = (table[first] == mark[:, None]).sum(1)
        return here + np.where(first != second, (table[second] == mark[:, None]).sum(1), 0)

    def delete(self, table: np.ndarray, h1: int, h2: int) -> bool:
        mark, a, b = self._place(table, h1, h2)
        for place in (a, b):
            here = np.flatnonzero(table[place] == mark)
            if len(here):
                table[place, here[0]] = 0
                return True
        return False

    def build(self, df: DataFrame, item: str, key: str) -> DataFrame:
        """Filters of the distinct items of each key: (key, shard, shards, filter), a shard for every so many items, so that no
        key has to fit into one task. No item is rejected, whatever their number."""
        me = self
        rows = df.where(F.col(item).isNotNull()).select(key, item).distinct()
        counts = rows.groupBy(key).agg(F.ceil(F.count("*") / self.SHARD_ITEMS).cast("int").alias("shards"))
        rows = rows.join(counts, key).select(key, "shards", *hash_pair(F.col(item))).withColumn("shard", self._shard())

        def fill(frame: pd.DataFrame) -> pd.DataFrame:
            tables: list[np.ndarray] = []
            for h1, h2 in zip(_u(frame["_h1"]).tolist(), _u(frame["_h2"]).tolist(), strict=True):
                me.add(tables, h1, h2)
            first = {c: [frame[c].iloc[0]] for c in (key, "shard", "shards")}
            return pd.DataFrame(first | {"filter": [b"".join(t.tobytes() for t in tables)]})

        kind = df.schema[key].dataType.simpleString()
        return rows.groupBy(key, "shard").applyInPandas(fill, f"{key} {kind}, shard int, shards int, filter binary")

    def _shard(self) -> Column:
        """The shard of an item, by bits that its place in a table doesn't use."""
        return F.pmod(F.shiftrightunsigned("_h2", 20), F.col("shards")).cast("int")

    def change(self, filters: DataFrame, items: DataFrame, item: str, key: str, op: str) -> DataFrame:
        """The filters after items (key, item) are added, added if absent (addnx: CF.ADDNX and INSERTNX), or deleted (del: CF.DEL);
        applied in order of their hashes. Items of keys without a filter open one, but for del."""
        me = self
        shards = filters.select(key, "shards").distinct()
        rows = items.where(F.col(item).isNotNull()).select(key, *hash_pair(F.col(item))).join(shards, key, "left")
        rows = rows.withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", self._shard())

        def apply(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            tables = [t.copy() for t in me.tables(old["filter"].iloc[0])] if len(old) else []
            new = new.sort_values(["_h1", "_h2"])
            for h1, h2 in zip(_u(new["_h1"]).tolist(), _u(new["_h2"]).tolist(), strict=True):
                if op == "del":
                    any(me.delete(t, h1, h2) for t in reversed(tables))
                elif op == "add" or not any(me.count(t, np.array([h1], np.uint64), np.array([h2], np.uint64))[0] for t in tables):
                    me.add(tables, h1, h2)
            named = old if len(old) else new
            if not tables:
                return pd.DataFrame({key: [], "shard": [], "shards": [], "filter": []})
            return pd.DataFrame({c: [named[c].iloc[0]] for c in (key, "shard", "shards")} | {"filter": [b"".join(t.tobytes() for t in tables)]})

        schema = f"{key} {filters.schema[key].dataType.simpleString()}, shard int, shards int, filter binary"
        return filters.groupBy(key, "shard").cogroup(rows.groupBy(key, "shard")).applyInPandas(apply, schema)

    def contains(self, filters: DataFrame, items: DataFrame, item: str, key: str) -> DataFrame:
        """count: how many marks match (0: surely absent). A filter goes once to every block of PROBED items, not to each."""
        me, kind = self, items.schema[item].dataType.simpleString()
        rows = items.select(key, item, *hash_pair(F.col(item))).join(filters.select(key, "shards").distinct(), key)
        rows = rows.withColumn("shard", self._shard()).withColumn("block", F.lit(0))
        blocks = rows.groupBy(key, "shard").agg(F.ceil(F.count("*") / self.PROBED).cast("int").alias("blocks"))
        rows = rows.join(blocks, [key, "shard"]).withColumn("block", F.pmod("_h1", F.col("blocks")).cast("int"))
        held = filters.join(blocks, [key, "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = rows.select(key, "shard", "block", item, "_h1", "_h2").unionByName(held.select(key, "shard", "block", "filter"), allowMissingColumns=True)
        both = both.repartition(key, "shard", "block").sortWithinPartitions(key, "shard", "block", F.desc_nulls_last("filter"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables: list[np.ndarray] = []
            for batch in batches:
                held = batch.column("filter")
                starts = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False)).tolist()
                for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                    if a < b and held[a].is_valid:
                        tables, a = me.tables(held[a].as_py()), a + 1
                    if a < b:
                        part = batch.slice(a, b - a)
                        h1, h2 = (part.column(c).to_numpy().view(np.uint64) for c in ("_h1", "_h2"))
                        hits = pa.array(sum(me.count(t, h1, h2) for t in tables), pa.int32())
                        yield pa.RecordBatch.from_arrays([part.column(key), part.column(item), hits], names=[key, item, "count"])

        return both.mapInArrow(probe, f"{key} {items.schema[key].dataType.simpleString()}, {item} {kind}, count int")

    def twins(self, items: DataFrame, item: str, key: str) -> DataFrame:
        """Of distinct items those that others of their key can't be told from: of one mark and one pair of buckets in the first
        table. Larger tables tell apart what the first does, and pairs of one mark are equal or disjoint, so the marks that match
        any other item are its own."""
        rows = items.select("*", *hash_pair(F.col(item)))
        low = F.col("_h2").bitwiseAND(F.lit(0xFFFF))
        rows = rows.withColumn("_mark", F.when(low == 0, 1).otherwise(low)).withColumn("_first", F.col("_h1").bitwiseAND(F.lit(self.buckets - 1)))
        second = F.col("_first").bitwiseXOR((F.col("_mark") * F.lit(0x5BD1E995)).bitwiseAND(F.lit(self.buckets - 1)))
        alike = Window.partitionBy(key, "_mark", F.least("_first", second))
        return rows.withColumn("_alike", F.count("*").over(alike)).where("_alike > 1").select(*items.columns)

    def settle(self, counts: DataFrame, asked: DataFrame, edits: list[tuple[str, DataFrame]], item: str, key: str) -> DataFrame:
        """counts (key, item, count) of the asked items made exact, for filters that the edits made (a build, then as in change):
        twins are counted by what the edits did to them, all others keep the filter's count."""
        times, n = [], F.lit(0)
        for i, (op, items) in enumerate([("ask", asked), *edits]):
            times.append(items.select(key, item, F.lit(i).alias("_edit")))
            k = F.col(f"_k{i}")
            once = F.least(k, F.lit(1))
            n = {"ask": n, "build": once, "addnx": F.greatest(n, once), "add": n + k, "del": F.greatest(n - k, F.lit(0))}[op]
        rows = reduce(DataFrame.union, times).where(F.col(item).isNotNull()).groupBy(key, item)
        rows = rows.agg(*[F.count_if(F.col("_edit") == i).alias(f"_k{i}") for i in range(len(times))])
        true = self.twins(rows, item, key).select(key, item, n.cast("int").alias("_true"))
        return counts.join(true, [key, item], "left").select(key, item, F.coalesce("_true", "count").alias("count"))

    def info(self, filters: DataFrame, key: str) -> DataFrame:
        """CF.INFO: of each key the buckets, the tables, the marks held and the bucket size."""
        me = self

        @F.pandas_udf("struct<buckets long, tables int, items long>")
        def measure(data: pd.Series) -> pd.DataFrame:
            found = [me.tables(d) for d in data]
            return pd.DataFrame({"buckets": [sum(map(len, ts)) for ts in found], "tables": [len(ts) for ts in found], "items": [int(sum((t != 0).sum() for t in ts)) for ts in found]})

        sums = [F.sum(f"m.{c}").cast("long").alias(c) for c in ("buckets", "tables", "items")]
        return filters.select(key, measure("filter").alias("m")).groupBy(key).agg(*sums).withColumn("bucket_size", F.lit(self.bucket))
