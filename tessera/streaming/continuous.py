"""Continuous queries: Join, Update and Leave events as entries come to match a condition, change, or stop matching.

A change feed has rows (key, op, value columns); op is created, modified, removed or expired. State per key is whether
the last value matched, so an event needs one boolean, kept by `transformWithState` semantics through
`applyInPandasWithState`, which runs on any state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tessera.plans.catalog import Catalog
from tessera.plans.compiler import QueryError
from tessera.plans.query import Query

JOIN, UPDATE, LEAVE = "JOIN", "UPDATE", "LEAVE"


def condition(catalog: Catalog, text: str, **params) -> Column:
    """The WHERE clause of a query that may run continuously: no grouping, aggregation or sorting."""
    query = Query(catalog, text)
    for k, v in params.items():
        query.param(k, v)
    s = query.statement
    compiler = query.compiler()
    if s.group or s.having or s.order or compiler.all_aggregates() or s.delete:
        raise QueryError("continuous queries don't support grouping, aggregation, sorting or DELETE")
    return query.matches()


def _tagged(feed: DataFrame, matches: Column, op: str) -> DataFrame:
    gone = F.col(op).isin("removed", "expired")
    return feed.withColumn("_match", ~gone & F.coalesce(matches, F.lit(False)))


def continuous(feed: DataFrame, matches: Column, key: str, values: list[str], op: str = "op", order: str | None = None) -> DataFrame:
    """A streaming feed to its events: (key, event, values...), values null on LEAVE. order sorts a batch's changes of a key."""
    tagged = _tagged(feed, matches, op)
    order_by = [order] if order else []
    kept = tagged.select(key, *dict.fromkeys([*values, *order_by]), "_match")
    out = T.StructType([kept.schema[key], T.StructField("event", T.StringType())] + [T.StructField(v, kept.schema[v].dataType) for v in values])
    state = T.StructType([T.StructField("matched", T.BooleanType())])

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        matched = held.get[0] if held.exists else False
        frame = pd.concat(list(frames))
        if order_by:
            frame = frame.sort_values(order_by, kind="stable")
        rows = []
        for row in frame.to_dict("records"):
            now = bool(row["_match"])
            if now or matched:
                event = (UPDATE if matched else JOIN) if now else LEAVE
                rows.append({key: k[0], "event": event} | {v: row[v] if now else None for v in values})
            matched = now
        if matched:
            held.update((True,))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(rows, columns=out.names)

    return kept.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def replay(feed: DataFrame, matches: Column, key: str, values: list[str], order: str, op: str = "op") -> DataFrame:
    """The events that a whole feed gives, as a batch: the state is the previous row of the key, so a window is enough."""
    tagged = _tagged(feed, matches, op)
    before = F.coalesce(F.lag("_match").over(Window.partitionBy(key).orderBy(order)), F.lit(False))
    event = F.when(F.col("_match") & ~before, JOIN).when(F.col("_match"), UPDATE).when(before, LEAVE)
    return tagged.withColumn("event", event).filter("event IS NOT NULL").select(key, "event", *[F.when(F.col("_match"), F.col(v)).alias(v) for v in values], order)


def with_initial_state(snapshot: DataFrame, feed: DataFrame, op: str = "op") -> DataFrame:
    """The current contents delivered as created events before the feed."""
    return snapshot.withColumn(op, F.lit("created")).unionByName(feed, allowMissingColumns=True)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """created, modified and removed rows between two states of a table: one full join on the key."""
    rest = [c for c in after.columns if c != key]
    a, b = before.select(key, F.struct(*rest).alias("_old")), after.select(key, F.struct(*rest).alias("_new"))
    joined = a.join(b, key, "full")
    op = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return joined.withColumn("op", op).filter("op IS NOT NULL").select(key, "op", "_new.*")


def match_many(df: DataFrame, filters: dict[str, Column], name: str = "matched") -> DataFrame:
    """Many standing filters in one pass: the names of those that each row matches."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in filters.items()])))


def unexpired(df: DataFrame, now: Column, lifespan: str | None = None, max_idle: str | None = None, created: str = "created", used: str = "used") -> DataFrame:
    """Entries within their lifespan since creation and max idle time since use (intervals such as '10 minutes')."""
    if lifespan:
        df = df.filter(F.col(created) + F.expr(f"INTERVAL {lifespan}") > now)
    if max_idle:
        df = df.filter(F.col(used) + F.expr(f"INTERVAL {max_idle}") > now)
    return df


def deduplicated(feed: DataFrame, event_id: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Retried notifications dropped: within a watermark, or in the whole of a batch."""
    if not feed.isStreaming:
        return feed.dropDuplicates([event_id])
    return feed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])


def windowed_counts(feed: DataFrame, ts: str, width: str, *keys: str, delay: str = "10 minutes") -> DataFrame:
    """Extension: event-time windows with a watermark."""
    return feed.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
