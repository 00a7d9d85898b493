"""What the operators of this subpackage share: words, tables cut into the shared folder, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost executor costs a re-read only."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of cut tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Words in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has no more than so many rows (which the caller knows to be narrow), else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
