"""Data-structure commands against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import spatial
from tessera.operators import bitmaps, geo, hashes, json_docs, lists, multimap, sets, sketches, strings
from tessera.operators.keyspace import Keyspace, glob
from tessera.operators.sortedsets import SortedSet
from tessera.operators.tasks import ALL_NODES, Task, Tasks, collect_by


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row) if len(columns) > 1 else row[0]


def test_strings(spark):
    v = F.lit("Hello World")
    assert one(spark, strings.get_range(v, 0, 4), strings.get_range(v, -5, -1), strings.get_range(v, 5, 2), strings.set_range(v, 6, "Redis"), strings.set_range(F.lit("a"), 3, "b"), strings.strlen(F.lit("é"))) == ["Hello", "World", "", "Hello Redis", "a\0\0b", 2]
    assert one(spark, strings.incr_by(F.lit("41")), strings.decr_by(F.lit(None).cast("string"), 3), strings.append(F.lit(None).cast("string"), "x")) == [42, -3, "x"]
    for bad in ("9223372036854775807", "x1"):
        with pytest.raises(Exception, match="overflow|not an integer"):
            one(spark, strings.incr_by(F.lit(bad)))
    assert spark.createDataFrame([("ohmytext", "mynewtext")], "a string, b string").select(strings.lcs(F.col("a"), F.col("b")), strings.digest(F.col("a"))).first()[0] == "mytext"


def test_keys(spark):
    k = Keyspace(spark.createDataFrame([("a", 1), ("b", 2), ("c[1]", 3)], "key string, value int"))
    as_dict = lambda s: {r["key"]: r["value"] for r in s.df.collect()}
    assert as_dict(k.set({"a": 5, "d": 6})) == {"a": 5, "b": 2, "c[1]": 3, "d": 6}
    assert as_dict(k.setnx({"a": 5, "d": 6})) == {"a": 1, "b": 2, "c[1]": 3, "d": 6}
    assert as_dict(k.set({"a": 5, "d": 6}, "xx")) == {"a": 5, "b": 2, "c[1]": 3}
    assert as_dict(k.msetnx({"a": 5, "d": 6})) == as_dict(k)
    assert as_dict(k.delete_if("a", 2)) == as_dict(k) and "a" not in as_dict(k.delete_if("a", 1))
    assert as_dict(k.rename("a", "b")) == {"b": 1, "c[1]": 3} and as_dict(k.rename("a", "b", only_free=True)) == as_dict(k)
    with pytest.raises(KeyError):
        k.rename("zz", "b")
    twice = spark.createDataFrame([("a", 7, 1), ("a", 6, 2)], "key string, value int, _at int")
    assert as_dict(k.set(twice))["a"] == 6 and as_dict(k.set(twice.drop("_at")))["a"] == 7
    assert k.exists(["a", "a", "z"]).first()["n"] == 2
    assert [r["key"] for r in k.keys("c\\[?]").collect()] == ["c[1]"] and glob("h[ae]llo*") == "^h[ae]llo(?s:.*)$"
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    timed = k.expire(["a"], now + F.expr("INTERVAL 90 SECONDS"))
    assert {r["key"]: r["ttl"] for r in timed.ttl(now).collect()} == {"a": 90, "b": -1, "c[1]": -1}
    assert "a" not in as_dict(timed.alive(now + F.expr("INTERVAL 2 MINUTES"))) and "a" in as_dict(timed.persist(["a"]).alive(now + F.expr("INTERVAL 2 MINUTES")))


def test_hashes_lists_sets(spark):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(spark, hashes.hset(m, {"b": 3, "c": 4}), hashes.hsetnx(m, "b", 9), hashes.hdel(m, ["a"]), hashes.hincrby(m, "z", 5), hashes.hmget(m, ["a", "x"]), hashes.hexists(m, "x")) == [{"a": 1, "b": 3, "c": 4}, {"a": 1, "b": 2}, {"b": 2}, {"a": 1, "b": 2, "z": 5}, [1, None], False]
    a = F.array(*map(F.lit, [1, 2, 3, 2, 1]))
    empty = F.array().cast("array<int>")
    assert one(spark, lists.lrange(a, -2, -1), lists.lrange(a, 3, 1), lists.lrem(a, 1, 2), lists.lrem(a, -1, 2), lists.lrem(a, 0, 1), lists.lset(a, -1, 9), lists.lpos(a, 2, -1), lists.lpos(a, 7)) == [[2, 1], [], [1, 3, 2, 1], [1, 2, 3, 1], [2, 3, 2], [1, 2, 3, 2, 9], 3, None]
    assert one(spark, *lists.lpop(a, 2), *lists.rpop(a, 2), lists.linsert(a, 3, 8), lists.lpushx(empty, 1), lists.rotate(a), lists.lmpop([empty, a], 1), lists.lpush(a, 7, 8)) == [[1, 2], [3, 2, 1], [1, 2], [1, 2, 3], [1, 2, 8, 3, 2, 1], [], [1, 1, 2, 3, 2], [1], [8, 7, 1, 2, 3, 2, 1]]
    x, y = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))
    assert one(spark, sets.sunion(x, y), sets.sinter(x, y), sets.sdiff(x, y), sets.sintercard(x, y, limit=1), *sets.smove(x, y, "a"), sets.smismember(x, ["a", "z"])) == [list("abcd"), ["b", "c"], ["a"], 1, ["b", "c"], list("bcda"), [True, False]]
    assert set(one(spark, sets.spop(x, 2))) < set("abc")


def test_sorted_sets(spark):
    z = SortedSet(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 4.0)], "member string, score double"))
    names = lambda df: [r["member"] for r in df.collect()]
    assert names(z.range(0, -1)) == list("abcd") or sorted(names(z.range(0, -1))) == list("abcd")
    assert names(z.range(-2, -1)) == ["c", "d"] and names(z.range(0, 1, reverse=True)) == ["d", "c"]
    assert z.rank("c").first()["rank"] == 2 and z.rank("c", reverse=True).first()["rank"] == 1 and z.count(2, 4).first()["n"] == 3
    taken, rest = z.pop(1, largest=True)
    assert names(taken) == ["d"] and sorted(names(rest.df)) == list("abc")
    new = spark.createDataFrame([("a", 0.5), ("e", 9.0)], "member string, score double")
    scores = lambda s: {r["member"]: r["score"] for r in s.df.collect()}
    assert scores(z.add(new))["a"] == 0.5 and scores(z.add(new, "nx"))["a"] == 1.0 and "e" not in scores(z.add(new, "xx")) and scores(z.add(new, "gt"))["a"] == 1.0 and scores(z.incr_by(new))["a"] == 1.5
    other = SortedSet(new)
    assert scores(z.inter(other, weights=[2, 3], aggregate="sum")) == {"a": 3.5} and "a" not in scores(z.diff(other)) and z.inter_card(other).first()["n"] == 1
    assert sorted(names(z.rem_range_by_score(2, 2).df)) == ["a", "d"] and sorted(names(z.rem_range_by_rank(0, 1).df)) == ["c", "d"] and names(z.range_by_lex("(a", "[c")) == ["b", "c"]


def test_bitmaps(spark):
    v = F.lit("foobar").cast("binary")
    assert one(spark, bitmaps.bit_count(v), bitmaps.bit_count(v, 1, 1), bitmaps.bit_count(v, 5, 30, "bit"), bitmaps.bit_pos(F.unhex(F.lit("fff0")), 0), bitmaps.bit_pos(F.unhex(F.lit("ff")), 0), bitmaps.bit_pos(F.unhex(F.lit("00")), 1), bitmaps.get_bit(v, 1)) == [26, 6, 17, 12, 8, -1, 1]
    bits = lambda c: F.lower(F.hex(c))
    a, b, c = (F.unhex(F.lit(x)) for x in ("f0ff", "3c", "81"))
    assert one(spark, bits(bitmaps.bit_op("AND", a, b)), bits(bitmaps.bit_op("OR", a, b)), bits(bitmaps.bit_op("XOR", a, b)), bits(bitmaps.bit_op("NOT", b)), bits(bitmaps.bit_op("DIFF", a, b, c)), bits(bitmaps.bit_op("ONE", a, b, c)), bits(bitmaps.set_bit(F.unhex(F.lit("00")), 15, 1))) == ["3000", "fcff", "ccff", "c3", "40ff", "4dff", "0001"]
    assert one(spark, bitmaps.bitfield_get(a, "u4", 0), bitmaps.bitfield_get(a, "i4", 0), bits(bitmaps.bitfield_set(a, "u8", 4, 0xAB)), bitmaps.bitfield_incrby(a, "u8", 8, 2), bitmaps.bitfield_incrby(a, "u8", 8, 2, "SAT"), bitmaps.bitfield_incrby(a, "u8", 8, 2, "FAIL")) == [15, -1, "fabf", 1, 255, None]


def test_json(spark):
    doc = {"a": {"b": [1, 2, 3], "s": "x"}, "n": 4, "t": True}
    df = spark.createDataFrame([(json.dumps(doc),)], "d string")
    d = F.col("d")
    get = lambda c: json.loads(df.select(c).first()[0])
    assert get(json_docs.json_set(d, "$.a.c", 5))["a"]["c"] == 5 and get(json_docs.json_set(d, "$.n", 5, "nx"))["n"] == 4 and "z" not in get(json_docs.json_set(d, "$.z", 5, "xx"))
    assert "b" not in get(json_docs.delete(d, "$.a.b"))["a"] and get(json_docs.delete(d, "$.a.b[-1]"))["a"]["b"] == [1, 2]
    assert get(json_docs.arr_append(d, "$.a.b", 4))["a"]["b"] == [1, 2, 3, 4] and get(json_docs.arr_insert(d, "$.a.b", 1, 9))["a"]["b"] == [1, 9, 2, 3] and get(json_docs.arr_pop(d, "$.a.b"))["a"]["b"] == [1, 2] and get(json_docs.arr_trim(d, "$.a.b", 1, -1))["a"]["b"] == [2, 3]
    assert get(json_docs.num_mult_by(d, "$.n", 3))["n"] == 12 and get(json_docs.toggle(d, "$.t"))["t"] is False and get(json_docs.str_append(d, "$.a.s", "y"))["a"]["s"] == "xy" and get(json_docs.clear(d, "$.a")) == doc | {"a": {}}
    assert get(json_docs.merge(d, "$", {"n": None, "a": {"s": 1}})) == {"a": {"b": [1, 2, 3], "s": 1}, "t": True} and get(json_docs.num_incr_by(d, "$.a.b[*]", 1))["a"]["b"] == [2, 3, 4]
    assert list(df.select(json_docs.json_type(d, "$.a"), json_docs.json_type(d, "$.a.b"), json_docs.json_type(d, "$.n"), json_docs.json_type(d, "$.t"), json_docs.json_type(d, "$.q")).first()) == ["object", "array", "integer", "boolean", None]
    assert list(df.select(json_docs.arr_len(d, "$.a.b"), json_docs.obj_keys(d, "$.a"), json_docs.arr_index(d, "$.a.b", 2), json_docs.str_len(d, "$.a.s")).first()) == [3, ["b", "s"], 1, 1]


def test_sketches(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("x"), (F.col("id") % 2).alias("k"))
    cms = sketches.CountMin(2000, 5)
    found = {r["x"]: r["estimate"] for r in cms.query(cms.build(df, "x"), spark.range(500).withColumnRenamed("id", "x"), "x").collect()}
    assert all(6 <= n <= 12 for n in found.values())
    bloom = sketches.Bloom(500, 0.01)
    built = bloom.build(df, "x")
    asked = bloom.contains(built, spark.range(2000).withColumnRenamed("id", "x"), "x")
    rows = {r["x"]: r["found"] for r in asked.collect()}
    assert all(rows[x] for x in range(500)) and sum(rows[x] for x in range(500, 2000)) < 60
    assert abs(bloom.card(built).first()["n"] - 500) < 25
    cuckoo = sketches.Cuckoo(400)
    held = cuckoo.build(df, "x", "k")
    assert cuckoo.info(held, "k").agg(F.sum("items")).first()[0] == 500
    seen = cuckoo.contains(held, df.select("k", "x").distinct(), "x", "k")
    assert seen.filter("count = 0").count() == 0
    import numpy as np

    table = np.zeros((cuckoo.buckets, cuckoo.bucket), np.uint16)
    at = np.array([5], np.uint64), np.array([77], np.uint64)
    assert cuckoo.insert(table, 5, 77) and cuckoo.count(table, *at) == 1 and cuckoo.delete(table, 5, 77) and cuckoo.count(table, *at) == 0
    assert abs(sketches.pf_add(df, "x").select(sketches.pf_count()).first()[0] - 500) < 20


def test_cuckoo_beyond_its_capacity(spark):
    df = spark.range(3000).select(F.col("id").alias("x"), (F.col("id") % 2).alias("k"))
    cuckoo = sketches.Cuckoo(200)
    held = cuckoo.build(df, "x", "k")
    seen = cuckoo.contains(held, df, "x", "k")
    assert seen.count() == 3000 and seen.filter("count = 0").count() == 0
    others = df.select((F.col("x") + 3000).alias("x"), "k")
    assert cuckoo.contains(held, others, "x", "k").filter("count > 0").count() < 30
    import numpy as np

    # A failed insertion moves nothing; as many equal items as one likes find a place.
    table = np.zeros((cuckoo.buckets, cuckoo.bucket), np.uint16)
    full = [cuckoo.insert(table, 5, 77) for _ in range(8)]
    before = table.copy()
    assert all(full) and not cuckoo.insert(table, 5, 77) and (table == before).all()
    tables = []
    for _ in range(50):
        cuckoo.add(tables, 5, 77)
    at = np.array([5], np.uint64), np.array([77], np.uint64)
    assert sum(cuckoo.count(t, *at)[0] for t in cuckoo.tables(b"".join(t.tobytes() for t in tables))) == 50


def test_cuckoo_in_shards(spark, monkeypatch):
    monkeypatch.setattr(sketches.Cuckoo, "SHARD_ITEMS", 100)
    monkeypatch.setattr(sketches.Cuckoo, "PROBED", 50)
    df = spark.range(900).select(F.col("id").alias("x"), F.lit("hot").alias("k"))
    cuckoo = sketches.Cuckoo(150)
    held = cuckoo.build(df, "x", "k")
    assert held.count() == 9 and cuckoo.contains(held, df, "x", "k").filter("count > 0").count() == 900
    less = cuckoo.change(held, df.where("x < 300"), "x", "k", "del")
    assert cuckoo.info(less, "k").first()["items"] == 600
    assert cuckoo.contains(less, df, "x", "k").filter("count > 0 AND x >= 300").count() == 600


def test_bounded_counters(spark):
    rows = [("a", 60), ("a", -20), ("b", -5), ("b", 7), ("b", 100), ("b", -1), ("c", None)]
    df = spark.createDataFrame([(k, d, i) for i, (k, d) in enumerate(rows)], "k string, d int, at int").repartition(3)
    got = {r["k"]: r["value"] for r in multimap.counter_values(df, "k", "d", 0, 0, 50, "at").collect()}
    assert got == {"a": 30, "b": 49, "c": 0}
    import random

    rng = random.Random(1)
    deltas = [rng.randrange(-30, 31) for _ in range(2000)]
    value = 10
    for d in deltas:
        value = min(max(value + d, -40), 70)
    hot = spark.createDataFrame([("hot", d, i) for i, d in enumerate(deltas)], "k string, d int, at int")
    assert multimap.counter_values(hot, "k", "d", 10, -40, 70, "at").first()["value"] == value
    with pytest.raises(ValueError):
        multimap.counter_values(df, "k", "d", 0, 0, 50)


def test_geo(spark):
    assert one(spark, spatial.geo_score(F.lit(38.115556), F.lit(13.361389))) == 3479099956230698
    assert one(spark, spatial.geohash(F.lit(38.115556), F.lit(13.361389))) == "sr1t2n3rnbh"
    score = geo.add(F.lit(15.087269), F.lit(37.502669))
    assert one(spark, geo.distance_of(geo.add(F.lit(13.361389), F.lit(38.115556)), score, "km")) == pytest.approx(166.2742, abs=1e-3)
    assert one(spark, geo.distance(F.lit(13.361389), F.lit(38.115556), F.lit(15.087269), F.lit(37.502669))) == pytest.approx(166274.15, abs=0.5)
    df = spark.createDataFrame([("Palermo", 13.361389, 38.115556), ("Catania", 15.087269, 37.502669)], "member string, longitude double, latitude double")
    assert [r["member"] for r in geo.search(df, 15, 37, radius=200, in_unit="km", descending=False).collect()] == ["Catania", "Palermo"]
    assert [r["member"] for r in geo.search(df, 15, 37, width=200, height=200, in_unit="km").collect()] == ["Catania"]
    assert one(spark, geo.position(score))["longitude"] == pytest.approx(15.087269, abs=3e-6)
    with pytest.raises(Exception, match="invalid longitude"):
        one(spark, geo.add(F.lit(200.0), F.lit(2.0)))


def test_multimaps_and_tasks(spark):
    mm = multimap.Multimap(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3)], "key string, value int"))
    assert mm.size().first()["n"] == 3 and mm.contains("a", 2).first()["found"] and not mm.remove("a").contains("a").first()["found"]
    assert {r["key"]: r["values"] for r in mm.get().collect()} == {"a": [1, 2], "b": [3]}
    tasks = Tasks(spark)
    tasks.sql_script("add", "SELECT :x + :y AS z", "x", "y")
    assert tasks.execute("add", x=1, y=2).first()["z"] == 3
    tasks.register(Task("twice", lambda frames, by: (f.assign(value=f["value"] * by) for f in frames), ALL_NODES, "key string, value int", ("by",)))
    assert sorted(r["value"] for r in tasks.execute("twice", mm.df, by=2).collect()) == [2, 4, 6]
    with pytest.raises(ValueError):
        tasks.execute("twice", mm.df)
    out = collect_by(mm.df, ["key"], "total long", lambda: 0, lambda s, f: s + int(f["value"].sum()), lambda a, b: a + b, lambda s: {"total": s})
    assert {r["key"]: r["total"] for r in out.collect()} == {"a": 3, "b": 3}


def test_cuckoo_twins_settled(spark):
    """Items of one mark and pair of buckets are counted by the edits, also some that were never added."""
    df, cuckoo = spark.range(3000).selectExpr("'a' AS k", "id AS x"), sketches.Cuckoo(8)
    asked = df.union(spark.range(10_000, 12_000).selectExpr("'a' AS k", "id AS x"))
    edits = [("addnx", df), ("del", df.where("x % 3 = 0")), ("add", df.where("x % 3 = 1"))]
    filters = cuckoo.build(df, "x", "k")
    for op, items in edits:
        filters = cuckoo.change(filters, items, "x", "k", op)
    raw = cuckoo.contains(filters, asked, "x", "k").localCheckpoint()
    want = {x: [0, 2, 1][x % 3] if x < 3000 else 0 for x in [*range(3000), *range(10_000, 12_000)]}
    assert {r["x"]: r["count"] for r in raw.collect()} != want
    assert {r["x"]: r["count"] for r in cuckoo.settle(raw, asked, [("build", df), *edits], "x", "k").collect()} == want


def test_bloom_confirmed(spark):
    """A filter holding ten times its capacity finds what was never added, until that is looked up."""
    df, bloom = spark.range(1000).toDF("x"), sketches.Bloom(100, 0.01)
    raw = bloom.contains(bloom.build(df, "x"), spark.range(2000).toDF("x"), "x")
    assert raw.where("found").count() > 1100
    assert {r["x"] for r in bloom.confirm(raw, "x", df, "x").where("found").collect()} == set(range(1000))


def test_estimates_settled(spark):
    """Sketches far too small for their items: the exact check that follows mends every estimate."""
    df = spark.range(3000).selectExpr("'a' AS k", "id % 1000 AS x", "id % 7 AS by")
    cms = sketches.CountMin(150, 3)
    asked = df.select("x").distinct().union(spark.range(5000, 5100).toDF("x"))
    for by in (None, "by"):
        want = {r["x"]: r["n"] for r in df.groupBy("x").agg(F.sum(by) if by else F.count("*")).toDF("x", "n").collect()}
        raw = cms.query(cms.build(df, "x", by), asked, "x")
        assert any(r["estimate"] != want.get(r["x"], 0) for r in raw.collect())
        assert {r["x"]: r["estimate"] for r in cms.settle(raw, df, "x", by).collect()} == {x: want.get(x, 0) for x in [*range(1000), *range(5000, 5100)]}


def test_hll_settled(spark):
    df = spark.range(20_000).selectExpr("CAST(nullif(id % 3, 2) AS STRING) AS k", "id AS x")
    got = sketches.pf_settle(sketches.pf_add(df, "x", "k", lg_k=8), df, "x", "k", lg_k=8).collect()
    assert {r["k"]: r["n"] for r in got} == {"0": 6667, "1": 6667, None: 6666} and any(r["estimate"] != r["n"] for r in got)


def test_geo_ties(spark):
    df = spark.range(2000).selectExpr("1999 - id AS member", "15D AS longitude", "37D + id % 2 AS latitude").repartition(7)
    assert [r["member"] for r in geo.search(df, 15, 37, radius=500, in_unit="km", count=5, ties=("member",)).collect()] == [1, 3, 5, 7, 9]
