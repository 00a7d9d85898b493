"""Continuous queries on a real stream, standing filters, stores and transcoders."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.catalog import Catalog
from tessera.plans.compiler import QueryError
from tessera.plans.query import query
from tessera.sources import stores
from tessera.streaming import continuous


def test_continuous_query_on_a_stream(spark, tmp_path):
    schema = "id int, op string, age int, seq int"
    feed = [[(1, "created", 20, 1), (2, "created", 40, 2)], [(1, "modified", 35, 3), (2, "modified", 50, 4)], [(1, "modified", 10, 5), (2, "removed", None, 6)]]
    catalog = Catalog()
    catalog.register("Person", spark.createDataFrame([], schema))
    matches = continuous.condition(catalog, "from Person where age > :a", a=30)
    source, name = tmp_path / "in", "cq_events"
    source.mkdir()
    stream = spark.readStream.schema(schema).json(str(source))
    events = continuous.continuous(stream, matches, "id", ["age"], order="seq")
    running = events.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(feed):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{i}"))
            for part in (tmp_path / f"b{i}").glob("part*.json"):
                part.rename(source / f"{i}.json")
            running.processAllAvailable()
        got = sorted((r["id"], r["event"], r["age"] if r["age"] is None else int(r["age"])) for r in spark.table(name).collect() if r["age"] is not None)
        left = sorted(r["id"] for r in spark.table(name).filter("event = 'LEAVE'").collect())
    finally:
        running.stop()
    assert got == [(1, "JOIN", 35), (2, "JOIN", 40), (2, "UPDATE", 50)] and left == [1, 2]
    batch = continuous.replay(spark.createDataFrame([r for rows in feed for r in rows], schema), matches, "id", ["age"], "seq")
    assert sorted((r["seq"], r["event"]) for r in batch.collect()) == [(2, "JOIN"), (3, "JOIN"), (4, "UPDATE"), (5, "LEAVE"), (6, "LEAVE")]


@pytest.mark.parametrize("text", ["select count(*) from P", "from P order by a", "select a from P group by a"])
def test_continuous_restrictions(spark, text):
    catalog = Catalog()
    catalog.register("P", spark.createDataFrame([], "a int"))
    with pytest.raises(QueryError):
        continuous.condition(catalog, text)


def test_windows_with_watermark(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:05:10", "a"), ("2024-01-01 01:00:00", "b")], "ts string, k string").select(F.col("ts").cast("timestamp"), "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    running = continuous.windowed_counts(stream, "ts", "10 minutes", "k").writeStream.outputMode("complete").format("memory").queryName("w_counts").start()
    try:
        running.processAllAvailable()
        assert sorted((r["k"], r["n"]) for r in spark.table("w_counts").collect()) == [("a", 2), ("b", 1)]
    finally:
        running.stop()


def test_stores(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("v"))
    path = str(tmp_path / "s")
    stores.write_store(df, path, "id", segments=8)
    some = stores.read_store(spark, path, [1, 2])
    assert "PartitionFilters: [isnotnull" in some._jdf.queryExecution().toString() or "_segment" in some._jdf.queryExecution().toString()
    assert 0 < some.count() < 1000 and stores.read_store(spark, path).count() == 1000
    assert some.count() == stores.filter_segments(df, "id", [1, 2], 8).count()
    assert stores.compact(spark, path, str(tmp_path / "c")) == 1
    changed = stores.apply_modifications(df, spark.createDataFrame([(1, "put", 7, 1), (1, "remove", None, 2), (2, "put", 9, 1), (2000, "put", 5, 1)], "id long, op string, v long, at int"), "id", "at")
    got = {r["id"]: r["v"] for r in changed.filter("id in (1, 2, 2000)").collect()}
    assert got == {2: 9, 2000: 5} and changed.count() == 1000
    rest, n = stores.delete_where(df, F.col("id") < 10)
    assert n.first()["n"] == 10 and rest.count() == 990
    (tmp_path / "big.bin").write_bytes(bytes(range(256)) * 10)
    chunks = stores.read_chunks(spark, str(tmp_path / "big.bin"), 1000).orderBy("chunk").collect()
    assert b"".join(bytes(r["bytes"]) for r in chunks) == bytes(range(256)) * 10 and len(chunks) == 3
    assert stores.custom_schema({"a": "numeric", "b": "int4"}) == "a double, b int"
    assert stores.from_xml(stores.to_xml(df.limit(1)), "id long, v long").first()["v"] == 0


def test_jdbc_tables_and_queries(spark, tmp_path):
    """A store in the embedded database that comes with Spark."""
    url, how = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, "c", 2.5)], "id int, name string, amount double")
    stores.write_jdbc(rows, url, "entries", mode="overwrite", createTableColumnTypes="name varchar(20)", **how)
    stores.write_jdbc(rows.where("id = 1").withColumn("id", F.lit(4)), url, "entries", createTableColumnTypes="name varchar(20)", **how)
    back = stores.jdbc_table(spark, url, "entries", **how)
    assert sorted(tuple(r) for r in back.collect()) == sorted([(1, "a", 1.5), (2, "b", None), (3, "c", 2.5), (4, "a", 1.5)], key=lambda r: r[0])
    found = stores.jdbc_query(spark, url, 'SELECT "name", count(*) AS n FROM entries GROUP BY "name"', **how)
    assert {r[0]: r[1] for r in found.collect()} == {"a": 2, "b": 1, "c": 1}
    # Key look-ups and segments go to the database as conditions.
    plan = back.where(F.col("id").isin(2, 3))._jdf.queryExecution().toString()
    assert "PushedFilters: [*In(" in plan.replace("ID", "id") or "In(" in plan
    catalog = Catalog()
    catalog.register("entries", back.toDF("id", "name", "amount"), key="id")
    assert [r[0] for r in query(catalog, "select id from entries where amount > 1 order by id desc").df().collect()] == [4, 3, 1]
    assert stores.custom_schema({"a": "int4", "b": "blob", "c": "odd"}) == "a int, b binary, c odd"


def test_streams_time_out(spark):
    from tessera.operators.stream import Stream

    def slow(frames):
        import time

        for f in frames:
            time.sleep(60)
            yield f

    numbers = Stream.of(spark.range(4), "id")
    assert numbers.timeout(60).find_first() == 0 and [len(b) for b in numbers.batches(3)] == [3, 1]
    with pytest.raises(TimeoutError):
        numbers.map_batches(slow, "value long").timeout(2).for_each_partition(lambda rows: None)
