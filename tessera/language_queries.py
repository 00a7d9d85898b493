"""More registered queries: the query language, the functional stream, tasks, stores and feeds, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators import tasks
from tessera.operators.stream import Stream
from tessera.plans.query import query
from tessera.queries import TOK, asked, register
from tessera.sources import index, stores
from tessera.streaming import continuous

# Full text: analyzers
STEMS = r"list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"


@register("text_simple_analyzer", f"SELECT doc_id FROM documents WHERE list_contains({TOK}, 'worthless')")
def _(t):
    t.catalog.register("simples", t.documents, key="doc_id", analyzers={"text": "simple"})
    return query(t.catalog, "select doc_id from simples where text : 'Worthless'").df()


@register("text_keyword_analyzer", "SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def _(t):
    t.catalog.register("types", t.part, key="p_partkey", analyzers={"p_type": "keyword"})
    return query(t.catalog, "select p_partkey from types where p_type : :kind", kind=t.part.agg(F.min("p_type")).first()[0]).df()


@register("text_filename_long", "SELECT c_custkey, c_custkey % 2 = 0 AS found FROM customer")
def _(t):
    """Names that differ after their 3000th character only."""
    long = t.customer.select("c_custkey", F.concat(F.repeat(F.lit("Dir/"), 800), F.when(F.col("c_custkey") % 2 == 0, "A.txt").otherwise("B.txt")).alias("path"))
    t.catalog.register("files", long, key="c_custkey", analyzers={"path": "filename"})
    hits = query(t.catalog, "select c_custkey from files where path : :p", p="dir/" * 800 + "a.txt").df()
    return t.customer.select("c_custkey").join(hits.withColumn("found", F.lit(True)), "c_custkey", "left").select("c_custkey", F.coalesce("found", F.lit(False)).alias("found"))


#: Words and the stems that the published algorithm gives them.
STEMMED = [
    ("consigning", "consign"), ("consistency", "consist"), ("consolatory", "consolatori"), ("conspicuously", "conspicu"), ("knackeries", "knackeri"), ("kneeling", "kneel"), ("knightly", "knight"),
    ("knives", "knive"), ("running", "run"), ("hoping", "hope"), ("skies", "sky"), ("happily", "happili"), ("generously", "generous"), ("communication", "communic"), ("luxuriated", "luxuri"),
    ("relational", "relat"), ("electricity", "electr"), ("adoption", "adopt"), ("sized", "size"), ("ties", "tie"), ("agreed", "agre"), ("boyish", "boyish"), ("formalize", "formal"),
]


@register("text_stemmer_analyzer", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in STEMMED) + ") w(word, stem)")
def _(t):
    """Words as they come in a text of stop words, upper case and punctuation: each is found by its own stem's word."""
    words = t.spark.createDataFrame([(w, f"The {w.upper()}, and it") for w, _ in STEMMED], "word string, text string")
    t.catalog.register("stemmed", words, key="word", analyzers={"text": "stemmer"})
    from tessera.functions import fulltext

    found = words.select("word", F.get(fulltext.stemmer(F.col("text")), 0).alias("stem"))
    hits = query(t.catalog, "select word from stemmed where text : ('consigned' or 'ran' or 'sky')").df().withColumn("hit", F.lit(True))
    return found.join(hits, "word", "left").where(F.col("hit").isNull() | F.col("word").isin("consigning", "skies")).select("word", "stem")


# The query language
@register("quoted_identifiers", 'SELECT n_name AS "order", n_regionkey AS "group by" FROM nation WHERE n_regionkey > 1')
def _(t):
    t.catalog.register("quoted", t.nation.select(F.col("n_name").alias("order"), F.col("n_regionkey").alias("group by")))
    return query(t.catalog, "select `order`, `group by` from quoted where `group by` > 1").df()


@register("member_of", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click'")
def _(t):
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    t.catalog.register("users", kinds, key="user_id")
    return query(t.catalog, "select user_id from users where 'click' member of kinds").df()


asked(
    "repeated_sort_keys",
    "select c_custkey from customer order by c_acctbal, c_custkey, c_acctbal desc",
    "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10",
    limit=10,
)
asked(
    "row_property",
    "select o_orderstatus, max(o_totalprice) as top from orders group by o_orderstatus having max(o_totalprice) > 1000 and count(*) > 2",
    "SELECT o_orderstatus, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING max(o_totalprice) > 1000 AND count(*) > 2",
)
asked(
    "filter_and_convert",
    "select c_name, c_nationkey from customer where not (c_acctbal >= 0) and c_mktsegment in ('BUILDING', 'MACHINERY')",
    "SELECT c_name, c_nationkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
)


@register("page_of_default", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    """execute(): a hundred rows unless told otherwise, within a timeout."""
    result = t.ask("select o_orderkey from orders order by o_orderkey").timeout(600).execute()
    return t.spark.createDataFrame(result.rows, "o_orderkey long").select(F.col("o_orderkey").cast(t.orders.schema["o_orderkey"].dataType).alias("o_orderkey"))


@register(
    "query_statistics",
    "SELECT 'select n_name from nation where n_regionkey = 1' AS query, CAST(2 AS BIGINT) AS count, CAST(2 * (SELECT count(*) FROM nation WHERE "
    "n_regionkey = 1) AS BIGINT) AS rows UNION ALL SELECT 'select r_name from region', 1, (SELECT count(*) FROM region)",
)
def _(t):
    for text in ("select n_name from nation where n_regionkey = 1", "select r_name from region", "select n_name from nation where n_regionkey = 1"):
        t.ask(text).execute()
    return t.catalog.statistics.df(t.spark).select("query", "count", "rows")


# The functional stream: primitive streams
def _numbers(t, name: str, sql_type: str, make) -> None:
    """One chain over each kind of primitive stream: filter, map, distinct, peek, boxed, sorted, skip, limit."""
    sql = f"SELECT CAST(v AS {sql_type}) AS value FROM (SELECT DISTINCT CAST(l_quantity AS {sql_type}) * 2 AS v FROM lineitem WHERE l_quantity > 5) ORDER BY 1 DESC LIMIT 9 OFFSET 4"
    register(name, sql)(
        lambda t: make(Stream.of(t.lineitem, "l_quantity")).filter(lambda v: v > 5).map(lambda v: v * 2).distinct().boxed().sorted(descending=True).peek(Observation(uuid.uuid4().hex), F.count("*").alias("n")).skip(4).limit(9).df
    )


_numbers(None, "stream_double", "DOUBLE", lambda s: s.map_to_double(lambda v: v))
_numbers(None, "stream_int", "INT", lambda s: s.map_to_int(lambda v: v))
_numbers(None, "stream_long", "BIGINT", lambda s: s.map_to_long(lambda v: v))


def _flat(name: str, kind: str, sql_type: str) -> None:
    sql = f"SELECT CAST(x AS {sql_type}) AS value FROM (SELECT unnest([n_nationkey, n_regionkey, 7]) AS x FROM nation)"
    register(name, sql)(lambda t: getattr(Stream.of(t.nation), f"flat_map_to_{kind}")(lambda n: F.array(n["n_nationkey"], n["n_regionkey"], F.lit(7))).df)


_flat("stream_flat_map_double", "double", "DOUBLE")
_flat("stream_flat_map_int", "int", "INT")
_flat("stream_flat_map_long", "long", "BIGINT")


@register(
    "stream_conversions",
    "SELECT CAST(n_regionkey AS DOUBLE) AS a, CAST(n_regionkey AS BIGINT) * 2 AS b, 'k' || n_regionkey AS c FROM (SELECT DISTINCT n_regionkey "
    "FROM nation)",
)
def _(t):
    """AsDouble, AsLong, MapToLong, MapToDouble and MapToObj of one stream of ints."""
    ints = Stream.of(t.nation, "n_regionkey").map_to_int(lambda v: v).distinct()
    a, b, c = ints.as_double().df, ints.as_long().map_to_long(lambda v: v * 2).df, ints.map_to_obj(lambda v: F.concat(F.lit("k"), v.cast("string"))).df
    keyed = lambda df, name, key: df.select(key.cast("long").alias("key"), F.col("value").alias(name))
    v = F.col("value")
    both = keyed(a, "a", v).join(keyed(b, "b", v / 2), "key").join(keyed(c, "c", F.substring(v, 2, 9)), "key")
    return both.select("a", "b", "c")


@register(
    "stream_terminals",
    "SELECT count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS sum, min(n_regionkey) AS min, max(n_regionkey) AS max, bool_and(n_regionkey < 5) "
    "AS all_, NOT bool_or(n_regionkey > 9) AS none_ FROM nation",
)
def _(t):
    s = Stream.of(t.nation, "n_regionkey").unordered()
    out = s.count().join(s.sum(), F.lit(True)).join(s.min(), F.lit(True)).join(s.max(), F.lit(True))  # one row each
    out = out.join(s.all_match(lambda v: v < 5).withColumnRenamed("matches", "all_"), F.lit(True))
    return out.join(s.none_match(lambda v: v > 9).withColumnRenamed("matches", "none_"), F.lit(True))


@register("stream_segments", "SELECT count(*) AS n, count(DISTINCT n_name) AS names FROM nation")
def _(t):
    """Streams of every third part of the key segments together give each element once."""
    parts = [Stream.of(t.nation).filter_key_segments(list(range(k, 256, 3)), lambda n: n["n_nationkey"]).map(lambda n: n["n_name"]).df for k in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.agg(F.count("*").alias("n"), F.count_distinct("value").alias("names"))


@register("stream_iterator", "SELECT n_name AS value, row_number() OVER (ORDER BY n_name) - 1 AS place FROM nation")
def _(t):
    """The elements as the driver's iterator gives them, and the first by findFirst."""
    s = Stream.of(t.nation, "n_name").sorted()
    rows = list(enumerate(s.iterator()))
    if s.find_first() != rows[0][1]:
        raise AssertionError("findFirst isn't the first element")
    return t.spark.createDataFrame([(v, i) for i, v in rows], "value string, place long")


@register("stream_split", "SELECT n_name AS value FROM nation")
def _(t):
    """The parts of a split stream have each element once."""
    parts = [p.df for p in Stream.of(t.nation, "n_name").split(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("stream_batches", "SELECT o_orderkey AS value, (row_number() OVER (ORDER BY o_orderkey) - 1) // 7 AS batch FROM orders WHERE o_orderkey < 100")
def _(t):
    """The driver's iterator in batches of seven, one partition computed ahead."""
    s = Stream.of(t.orders, "o_orderkey").filter(lambda v: v < 100).sorted().parallel_distribution().timeout(600)
    rows = [(v, k) for k, part in enumerate(s.batches(7)) for v in part]
    return t.spark.createDataFrame(rows, "value long, batch long").select(F.col("value").cast(t.orders.schema["o_orderkey"].dataType).alias("value"), "batch")


@register(
    "index_only_aggregation",
    f"SELECT x AS token, count(DISTINCT doc_id) AS texts, count(*) AS occurrences FROM (SELECT doc_id, unnest({TOK}) AS x FROM documents) GROUP "
    f"BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def _(t):
    """The tokens of most texts, from the index alone: no text is read."""
    rows = t.spark.read.parquet(_index(t))
    return rows.groupBy("token").agg(F.count("*").alias("texts"), F.sum("n").alias("occurrences")).orderBy(F.desc("texts"), "token").limit(20)


@register("stream_map_batches", "SELECT CAST(n_nationkey * n_nationkey AS BIGINT) AS value FROM nation")
def _(t):
    def squares(frames):
        for f in frames:
            yield pd.DataFrame({"value": f["value"].astype("int64") ** 2})

    return Stream.of(t.nation, "n_nationkey").map_batches(squares, "value long").df


# Tasks
@register("task_on_all_nodes", "SELECT n_regionkey + 100 AS value FROM nation")
def _(t):
    def run(frames, add):
        for f in frames:
            yield pd.DataFrame({"value": f["n_regionkey"] + add})

    known = tasks.Tasks(t.spark)
    known.register(tasks.Task("shift", run, tasks.ALL_NODES, f"value {t.nation.schema['n_regionkey'].dataType.simpleString()}", ("add",)))
    return known.execute("shift", t.nation, add=100)


@register("task_script", "SELECT r_name FROM region WHERE r_regionkey >= 2")
def _(t):
    known = tasks.Tasks(t.spark)
    t.region.createOrReplaceTempView("task_regions")
    known.sql_script("late", "SELECT r_name FROM task_regions WHERE r_regionkey >= :least", "least")
    return known.execute("late", least=2)


@register("task_query_access", "SELECT n_name FROM nation WHERE n_regionkey = 3")
def _(t):
    """A task that asks queries of its own."""
    t.catalog.register("nation", t.nation)
    known = tasks.Tasks(t.spark, t.catalog)
    known.register(tasks.Task("ask", lambda spark, context, region: context.query("select n_name from nation where n_regionkey = :r", r=region).df(), parameters=("region",)))
    return known.execute("ask", region=3)


@register("collector_by_key", "SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY 1")
def _(t):
    return tasks.collect_by(
        t.customer.select("c_nationkey", "c_acctbal"), ["c_nationkey"], "n long, most double", lambda: (0, None),
        lambda state, frame: (state[0] + len(frame), max(x for x in (state[1], frame["c_acctbal"].max()) if x is not None)),
        lambda a, b: (a[0] + b[0], max(a[1], b[1])), lambda state: {"n": state[0], "most": float(state[1])},
    )


@register("entry_processor", "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2) THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
def _(t):
    entries = t.nation.select("n_nationkey", "n_name")
    changed = entries.where("n_nationkey IN (1, 2)").withColumn("n_name", F.lower("n_name"))
    return tasks.process_entries(entries, "n_nationkey", [1, 2], changed)


# Stores
def _path(t) -> str:
    """A new folder where all executors can write."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


@register("segmented_store", "SELECT c_custkey, c_name FROM customer")
def _(t):
    """Written by segments, read back by two scans of some of them each."""
    path = _path(t)
    stores.write_store(t.customer.select("c_custkey", "c_name"), path, "c_custkey", segments=8)
    even, odd = (stores.read_store(t.spark, path, list(range(k, 8, 2)), ["c_custkey", "c_name"]) for k in (0, 1))
    return even.unionByName(odd)


@register("segment_filter", "SELECT c_custkey FROM customer")
def _(t):
    parts = [stores.filter_segments(t.customer.select("c_custkey"), "c_custkey", list(range(k, 256, 2))) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@register(
    "key_supplier",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def _(t):
    """Keys given as a list, and as a table."""
    entries = t.customer.select("c_custkey", "c_name")
    wanted = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return stores.filter_keys(entries, "c_custkey", [3, 5]).unionByName(stores.filter_keys(entries, "c_custkey", wanted)).distinct()


@register("store_compaction", "SELECT c_custkey, c_name, 1 AS files FROM customer")
def _(t):
    path = _path(t)
    stores.write_store(t.customer.select("c_custkey", "c_name").repartition(9), path)
    files = stores.compact(t.spark, path, path + "-compact")
    return stores.read_store(t.spark, path + "-compact").withColumn("files", F.lit(files))


@register("chunked_values", "SELECT c_custkey // 1000000 AS x, true AS whole FROM customer LIMIT 1")
def _(t):
    """A large value piece by piece gives the value again."""
    path = _path(t)
    stores.write_store(t.customer.coalesce(1), path)
    chunks = stores.read_chunks(t.spark, path + "/*.parquet", 1000)
    sizes = chunks.groupBy("path").agg(F.sum(F.octet_length("bytes")).alias("n"))
    files = t.spark.read.format("binaryFile").load(path + "/*.parquet").select("path", "length")
    return sizes.join(files, "path").select(F.lit(0).cast("long").alias("x"), (F.col("n") == F.col("length")).alias("whole"))


@register("delete_where", "SELECT count(*) FILTER (c_acctbal < 0) AS gone, count(*) FILTER (NOT c_acctbal < 0) AS kept FROM customer")
def _(t):
    left, gone = stores.delete_where(t.customer, F.col("c_acctbal") < 0)
    return gone.withColumnRenamed("n", "gone").join(left.agg(F.count("*").alias("kept")), F.lit(True))  # one row each


# Indexes
def _index(t) -> str:
    path = _path(t)
    index.build(t.documents, "doc_id", "text", path)
    return path


@register(
    "index_term",
    f"SELECT doc_id AS key, CAST(len(list_filter({TOK}, lambda x: x = 'the')) AS INT) AS n FROM documents WHERE list_contains({TOK}, 'the')",
)
def _(t):
    return index.term(t.spark, _index(t), "the")


@register("index_phrase", f"SELECT doc_id AS key FROM documents WHERE contains(' ' || array_to_string({TOK}, ' ') || ' ', ' of the and ')")
def _(t):
    return index.phrase(t.spark, _index(t), ["of", "the", "and"]).select("key")


@register("index_all_terms", f"SELECT doc_id AS key FROM documents WHERE list_contains({TOK}, 'worthless') AND list_contains({TOK}, 'the')")
def _(t):
    return index.every(t.spark, _index(t), ["worthless", "the"])


@register(
    "index_prefix",
    f"SELECT x AS token, count(DISTINCT doc_id) AS texts FROM (SELECT doc_id, unnest({TOK}) AS x FROM documents) WHERE x LIKE 'wor%' GROUP BY 1",
)
def _(t):
    return index.prefix(t.spark, _index(t), "wor")


@register(
    "index_statistics",
    f"SELECT count(DISTINCT x) AS tokens, count(DISTINCT (doc_id, x)) AS postings, count(*) AS occurrences, count(DISTINCT doc_id) AS texts FROM "
    f"(SELECT doc_id, unnest({TOK}) AS x FROM documents)",
)
def _(t):
    return index.statistics(t.spark, _index(t))


# Feeds
@register(
    "initial_state_events",
    "SELECT event_id, 'JOIN' AS event FROM events WHERE value > 50",
)
def _(t):
    """What a query finds at its start comes as Join events."""
    feed = continuous.with_initial_state(t.events, t.events.limit(0).withColumn("op", F.lit("")))
    return continuous.replay(feed, F.col("value") > 50, "event_id", ["value"], "event_id").select("event_id", "event")


@register(
    "leave_on_removal",
    """WITH f AS (SELECT event_id, user_id, event_type <> 'error' AND value > 50 AS m FROM events), g AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY event_id), false) AS b FROM f)
    SELECT event_id, CASE WHEN m AND NOT b THEN 'JOIN' WHEN m THEN 'UPDATE' ELSE 'LEAVE' END AS event FROM g WHERE m OR b""",
)
def _(t):
    """Entries that are removed or expire leave."""
    feed = t.events.withColumn("op", F.when(F.col("event_type") == "error", "expired").otherwise("modified"))
    return continuous.replay(feed, F.col("value") > 50, "user_id", ["value"], "event_id").select("event_id", "event")


@register(
    "max_idle",
    "SELECT event_id FROM events WHERE ts + INTERVAL 10 MINUTE > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AND ts - INTERVAL 2 HOUR + "
    "INTERVAL 3 HOUR > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def _(t):
    both = t.events.join(t.events.agg(F.max("ts").alias("last")), F.lit(True))  # one row
    used = both.withColumn("used", F.col("ts") - F.expr("INTERVAL 2 HOURS"))
    return continuous.unexpired(used, F.col("last") - F.expr("INTERVAL 1 HOUR"), lifespan="10 MINUTES", max_idle="3 HOURS", created="ts", used="used").select("event_id")


@register("retried_events", "SELECT event_id FROM events")
def _(t):
    """Notifications that came twice count once."""
    return continuous.deduplicated(t.events.select("event_id", "ts").unionByName(t.events.select("event_id", "ts")), "event_id", "ts").select("event_id")


@register("windowed_counts", "SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t) -> DataFrame:
    return continuous.windowed_counts(t.events, "ts", "2 hours", "event_type").select("window.start", "event_type", "n")
