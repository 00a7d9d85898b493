"""Stores of entries: Parquet folders, JDBC tables and queries, any Spark format; segmented layouts, compaction, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column types of SQL stores and the Spark types they are read as.
SQL_TYPES = {"int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "numeric": "double", "bool": "boolean", "text": "string", "varchar": "string", "blob": "binary", "timestamp": "timestamp"}


def segment(key: Column, segments: int = 256) -> Column:
    """The hash segment of a key."""
    return F.pmod(F.xxhash64(key), F.lit(segments)).cast("int")


def write_store(df: DataFrame, path: str, key: str | None = None, segments: int | None = None, max_records: int | None = None, mode: str = "overwrite") -> None:
    """A Parquet store; with segments, a folder for each, so that a scan of some reads only those."""
    if segments:
        df = df.withColumn("_segment", segment(F.col(key), segments)).repartition("_segment")
    writer = df.write.mode(mode)
    writer = writer.option("maxRecordsPerFile", max_records) if max_records else writer
    (writer.partitionBy("_segment") if segments else writer).parquet(path)


def read_store(spark: SparkSession, path: str, segments: list[int] | None = None, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    df = df.filter(F.col("_segment").isin(segments)) if segments is not None else df
    return df.select(*columns) if columns else df.drop("_segment") if "_segment" in df.columns else df


def filter_keys(df: DataFrame, key: str, keys: list | DataFrame) -> DataFrame:
    """A scan of given keys: a pushed-down list, or a semi-join where the keys are a table."""
    return df.join(keys, key, "left_semi") if isinstance(keys, DataFrame) else df.filter(F.col(key).isin(keys))


def filter_segments(df: DataFrame, key: str, wanted: list[int], segments: int = 256) -> DataFrame:
    return df.filter(segment(F.col(key), segments).isin(wanted))


def memory_over_store(memory: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Entries in memory, then those of the store that memory doesn't have."""
    return memory.unionByName(store.join(memory.select(key), key, "left_anti"))


def load_by_key(hits: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    return entries.join(hits, key)


def apply_modifications(entries: DataFrame, changes: DataFrame, key: str, order: str, op: str = "op") -> DataFrame:
    """Write-behind: the last put or remove of each key decides. One aggregation and one join on the key."""
    rest = [c for c in changes.columns if c not in (key, order, op)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(op, *rest), order).alias("_c")).select(key, "_c.*")
    return entries.join(last.select(key), key, "left_anti").unionByName(last.filter(F.col(op) == "put").drop(op))


def delete_where(df: DataFrame, matches: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and the number of rows removed."""
    test = F.coalesce(matches, F.lit(False))
    return df.filter(~test), df.filter(test).agg(F.count("*").alias("n"))


def compact(spark: SparkSession, path: str, target: str, file_bytes: int = 128 << 20) -> int:
    """Rewrite a store's small files as files of about file_bytes; returns how many there are."""
    df = spark.read.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    files = max(1, -(-size // file_bytes))
    df.repartition(files).write.mode("overwrite").parquet(target)
    return files


# JDBC
def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def jdbc_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def custom_schema(columns: dict[str, str]) -> str:
    """The customSchema option for columns of a SQL store."""
    return ", ".join(f"{c} {SQL_TYPES.get(t.lower(), t)}" for c, t in columns.items())


# transcoding
def to_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as a JSON hit."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def from_json(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")


def to_xml(df: DataFrame, column: str = "xml") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns)).alias(column))


def from_xml(df: DataFrame, schema: str, column: str = "xml") -> DataFrame:
    return df.select(F.from_xml(column, schema).alias("r")).select("r.*")


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    return F.unhex(c)


def to_base64(c: Column) -> Column:
    return F.base64(c)


def from_base64(c: Column) -> Column:
    return F.unbase64(c)


def read_chunks(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """Large values piece by piece: (path, chunk number, bytes)."""
    files = spark.read.format("binaryFile").load(path)
    numbered = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / chunk).cast("int") - 1, F.lit(0)))).alias("chunk"))
    return numbered.select("path", "chunk", F.substring("content", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("bytes"))
