"""A full-text index as a Parquet store: postings of the tokens of an attribute, for terms and phrases without reading texts.

A posting is (bucket, token, key, n, places). Files lie in a folder for each hash bucket of tokens and are sorted by token,
so a look-up reads one folder, and of its files only the row groups whose tokens may match. A frequent token's postings
are dealt over several files by key; building needs no gathering of a token's or a text's postings in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fulltext

BUCKETS, FILES = 64, 4


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(df: DataFrame, key: str, attribute: str, analyzer: str = "standard") -> DataFrame:
    """token, key, n and places (0-based, in order) of every token of each text; nulls have none. Keys are distinct."""
    tokens = fulltext.ANALYZERS[analyzer](F.col(attribute))
    each = df.where(F.col(attribute).isNotNull()).select(F.col(key).alias("key"), F.posexplode(tokens).alias("place", "token"))
    # A text's tokens lie together, so the places of each are gathered before the shuffle, which moves postings only.
    found = each.groupBy("token", "key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return found.select("token", "key", F.size("places").alias("n"), "places")


def build(df: DataFrame, key: str, attribute: str, path: str, analyzer: str = "standard") -> None:
    """The mass indexer: the index at path is replaced by one of all rows."""
    rows = postings(df, key, attribute, analyzer).withColumn("bucket", _bucket(F.col("token")))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(FILES))).sortWithinPartitions("bucket", "token", "key")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _of(spark: SparkSession, path: str, word: str) -> DataFrame:
    bucket = spark.range(1).select(_bucket(F.lit(word)).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("token") == word))


def term(spark: SparkSession, path: str, word: str) -> DataFrame:
    """key and n (occurrences) of every text that has the token."""
    return _of(spark, path, word).select("key", "n")


def every(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Keys of the texts that have all the tokens."""
    return reduce(lambda a, b: a.join(b, "key", "left_semi"), [term(spark, path, w).select("key") for w in dict.fromkeys(words)])


def _back(k: int):
    return lambda place: place - k


def phrase(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """key and n of every text in which the tokens follow one another."""
    found = _of(spark, path, words[0]).select("key", "places")
    for k, word in enumerate(words[1:], 1):
        later = _of(spark, path, word).select("key", F.transform("places", _back(k)).alias("there"))
        found = found.join(later, "key").select("key", F.array_intersect("places", "there").alias("places")).where(F.size("places") > 0)
    return found.select("key", F.size("places").alias("n"))


def prefix(spark: SparkSession, path: str, start: str) -> DataFrame:
    """Tokens that begin so, with the number of texts that have each."""
    return spark.read.parquet(path).where(F.col("token").startswith(start)).groupBy("token").agg(F.count("*").alias("texts"))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row: texts, distinct tokens, postings and occurrences."""
    rows = spark.read.parquet(path)
    tokens = rows.groupBy("token").agg(F.count("*").alias("postings"), F.sum("n").alias("occurrences"))
    sums = tokens.agg(F.count("*").alias("tokens"), F.sum("postings").alias("postings"), F.sum("occurrences").alias("occurrences"))
    return sums.join(rows.agg(F.count_distinct("key").alias("texts")), F.lit(True))  # one row each
