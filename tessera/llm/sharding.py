"""Two-pass external shuffle of whole rows, texts and all, into shards, with DataFrame operations only.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash. Pass 2 gathers each bucket as
one array, puts it into a fixed order and applies Spark's `shuffle`, a Fisher-Yates shuffle with a seed. The order of
all records is bucket after bucket; a record at place g of it goes to slot g div n of shard g mod n, so the shards' row
counts are at most one apart (law `rows`) and slots have no gaps. `write_shards` writes them as files, one folder a shard.

The hash is over a whole row and its number among the rows equal to it, so neither copies nor rows of one id nor those
without any meet in a bucket, and as equal rows are alike, a rerun deals them alike. Only rows whose hash occurs twice are
counted as rows before they are scattered; the others travel once. The number of buckets grows with the input's bytes, so
the largest array is bounded; the offsets are one row per bucket.

Defined results: null texts have size 1 and crc 0; rows without an id are rows like others; repeated rows each get their
own slot; an empty table gives an empty result. Columns that can't be compared (maps) can't be sharded along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, new_path

#: Hashes that occur twice and may be broadcast; with more of them all rows are counted before they are scattered.
REPEATS = 1_000_000


def keyed(df: DataFrame) -> DataFrame:
    """df's rows as structs, a hash of each (nulls count where they stand) and about how many bytes it takes in memory."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    nulls = F.array(*[F.col(c).isNull() for c in df.columns])
    width = sum(texts, F.lit(40 + 16 * len(df.columns))).cast("long")
    return df.select(F.struct(*df.columns).alias("row"), F.xxhash64(*df.columns, nulls).alias("key"), width.alias("width"))


def repeats(keys: DataFrame) -> DataFrame:
    """The hashes that occur more than once."""
    return cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shard-repeats")


def scatter(df: DataFrame, buckets: int, seed: int, repeated: DataFrame | None = None) -> DataFrame:
    """Rows of df and their bucket, dealt by row and number: rows that may be equal to others are counted first."""
    rows = keyed(df).select("row", "key")
    repeated = repeats(rows) if repeated is None else repeated
    if repeated.limit(REPEATS + 1).count() <= REPEATS:
        apart, again = (rows.join(F.broadcast(repeated), "key", how) for how in ("left_anti", "left_semi"))
    else:
        apart, again = rows.limit(0), rows
    counted = again.groupBy("row", "key").agg(F.count("*").alias("n"))
    each = apart.select("row", "key", F.lit(1).cast("long").alias("copy")).unionByName(counted.select("row", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")))
    return each.select("row", F.pmod(F.xxhash64(F.lit(seed), "key", "copy"), F.lit(buckets)).cast("int").alias("bucket"))


def external_shuffle(df: DataFrame, buckets: int, seed: int, repeated: DataFrame | None = None) -> DataFrame:
    """df's rows as structs in a random order: columns row, bucket and at (place in the bucket, from 0)."""
    spread = scatter(df, buckets, seed, repeated).repartition(buckets, "bucket")
    # One fixed order in each array and of the arrays in a partition: a task that runs again shuffles alike.
    arrays = spread.groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias("rows")).sortWithinPartitions("bucket")
    return arrays.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))


def bucket_count(df: DataFrame, width: int, bucket_bytes: int) -> int:
    """Enough buckets for arrays of bucket_bytes on average, and for every task to have some."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * tasks, math.ceil(width / bucket_bytes))


def shard(df: DataFrame, shards: int = 8, seed: int = 11, bucket_bytes: int = 16 << 20) -> DataFrame:
    """df with shard and slot. df should be read from files or a cut: it is read for hashes, for counts and for rows."""
    keys = cut(keyed(df).select("key", "width"), "shard-keys")
    buckets = bucket_count(df, keys.agg(F.sum("width")).first()[0] or 0, bucket_bytes)
    repeated = repeats(keys)
    counts = scatter(df, buckets, seed, repeated).groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("first"))
    placed = external_shuffle(df, buckets, seed, repeated).join(F.broadcast(offsets), "bucket")
    at = F.col("first") + F.col("at")
    return placed.select("row.*", (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 11, bucket_bytes: int = 16 << 20) -> None:
    """Shuffle whole documents and write them as path/shard=k, slots ascending in each file."""
    sharded = shard(docs, shards, seed, bucket_bytes)
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digests(docs: DataFrame, shards: int = 8, seed: int = 11) -> DataFrame:
    """Shard whole documents into files of the shared folder, and read from those their sizes, checksums and places."""
    path = new_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed)
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    back = docs.sparkSession.read.schema(f"{kinds}, slot long, shard int").parquet(path)
    return back.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot")
