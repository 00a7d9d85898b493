"""Mix sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Every document gets an exponential key -ln(u) / w, u a seeded hash of its id and w its quality weight. Within a source
the smallest keys win: prefix sums of the sizes in key order fill the part of the target that complete epochs leave.

Only the bin of keys in which the budget runs out is ever sorted: sums per (source, bin) tell which bin that is, so a
source that holds a third of all rows costs one partial aggregation and one small sort.

Defined results: null or empty texts have size 0 and are taken 0 times; null sources form one source, the last in
order; rows that repeat an id share its key and are taken together; an empty table gives an empty result; other columns
of the input pass through `mix_documents` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, n_words, small

WEIGHTS = (5.0, 2.0, 1.0)


def quality_weight(text: Column, size: Column) -> Column:
    """In [0.1, 1]: grows with length up to 200 words and with the share of characters that aren't markup symbols."""
    chars = F.greatest(F.char_length(F.coalesce(text, F.lit(""))), F.lit(1)).cast("double")
    clean = 1 - F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)) / chars
    return F.round(0.1 + 0.9 * F.least(size / F.lit(200.0), F.lit(1.0)) * clean, 6)


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, rounded so that other engines agree; u in (0, 1) from 48 bits of an md5."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return F.round(-F.log(u) / weight, 9)


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources(source, source_size) -> and target: min(cap * size, level * weight), the level such that all add up.

    Sources are few rows beside documents; one window over them orders them by the level at which each reaches its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("i", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("i") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("full", F.lit(float(cap)) * F.col("source_size")).withColumn("at", F.col("full") / F.col("weight"))
    everyone, by_cap = Window.partitionBy(F.lit(1)), Window.orderBy("at", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everyone))
        .withColumn("capped", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    enough = F.col("capped") + F.col("at") * F.col("open") >= F.col("budget")
    # The level is that of the first source, in order of caps, whose cap the budget doesn't reach.
    ranked = ranked.withColumn("cap_order", F.row_number().over(by_cap)).withColumn("reached", F.when(enough, F.col("cap_order")))
    first = F.col("cap_order") == F.min("reached").over(everyone)
    ranked = ranked.withColumn("first", first).withColumn("level", F.max(F.when(F.col("first"), (F.col("budget") - F.col("capped")) / F.col("open"))).over(everyone))
    target = F.least(F.col("full"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def keyed(docs: DataFrame, seed: int, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """doc_id, source, size, key of every document."""
    sized = docs.select("doc_id", "source", "text", n_words(F.col("text")).alias("size"))
    return sized.select("doc_id", "source", "size", exponential_key(F.col("doc_id"), weight(F.col("text"), F.col("size")), seed).alias("key"))


def source_plan(light: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size, target, complete epochs, and the last (key, doc_id, size) that the fraction takes."""
    rows = light.count()
    bins = max(64, min(1 << 16, rows // 20_000))
    binned = light.withColumn("bin", F.floor(F.lit(bins) * (1 - F.exp(-F.col("key")))).cast("int"))
    sums = cut(binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    aims = targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = cut(aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).coalesce(1), "mix-aims")

    along = Window.partitionBy("source").orderBy("bin")
    ordered = sums.withColumn("upto", F.sum("bin_size").over(along)).withColumn("before", F.col("upto") - F.col("bin_size"))
    last = (
        ordered.alias("b").join(small(aims, 10_000).alias("a"), F.expr("b.source <=> a.source"))
        .where("upto > rest").groupBy(F.col("a.source").alias("source"))
        .agg(F.min(F.struct("bin", "before", "rest")).alias("m")).select("source", F.col("m.bin").alias("last_bin"), "m.before", "m.rest")
    )
    last = cut(last.coalesce(1), "mix-last")
    edge = binned.alias("d").join(small(last, 10_000).alias("l"), F.expr("d.source <=> l.source AND d.bin = l.last_bin")).select("d.source", "key", "doc_id", "size", "before", "rest")
    # Rows that repeat an id and a size are one here, however many they are.
    edge = edge.groupBy("source", "key", "doc_id", "size", "before", "rest").agg(F.sum("size").alias("tied"))
    upto = F.col("before") + F.sum("tied").over(Window.partitionBy("source").orderBy("key", "doc_id", "size"))
    taken = edge.withColumn("upto", upto).where(F.col("upto") - F.col("tied") / 2 <= F.col("rest"))
    ends = taken.groupBy("source").agg(F.max(F.struct("key", "doc_id", "size")).alias("end"))
    plan = aims.alias("a").join(last.alias("l"), F.expr("a.source <=> l.source"), "left").join(ends.alias("e"), F.expr("a.source <=> e.source"), "left")
    return cut(plan.select("a.source", "source_size", "target", "epochs", F.lit(bins).alias("bins"), F.coalesce("last_bin", F.lit(1 << 30)).alias("last_bin"), "end").coalesce(1), "mix-plan")


def times(doc_key: Column, doc_id: Column, size: Column) -> Column:
    """How often the plan on the same row takes the document."""
    at = F.floor(F.col("bins") * (1 - F.exp(-doc_key))).cast("int")
    inside = (at < F.col("last_bin")) | ((at == F.col("last_bin")) & F.coalesce(F.struct(doc_key, doc_id, size) <= F.col("end"), F.lit(False)))
    return F.col("epochs") + inside.cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, weight: Callable[[Column, Column], Column] = quality_weight) -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken (size * times) of every document."""
    light = cut(keyed(docs, seed, weight), "mix-keys")
    plan = source_plan(light, weights, share, cap)
    joined = light.alias("d").join(small(plan, 10_000).alias("p"), F.expr("d.source <=> p.source"))
    joined = joined.select("d.doc_id", "d.source", "d.size", "source_size", "target", times(F.col("d.key"), F.col("d.doc_id"), F.col("d.size")).alias("times"))
    return joined.withColumn("taken", F.col("size") * F.col("times"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, weight: Callable[[Column, Column], Column] = quality_weight) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the plan takes it. Only the plan's few rows are moved."""
    light = cut(keyed(docs, seed, weight), "mix-keys")
    plan = source_plan(light, weights, share, cap)
    size = n_words(F.col("d.text"))
    key = exponential_key(F.col("d.doc_id"), weight(F.col("d.text"), size), seed)
    joined = docs.select(F.struct("*").alias("d")).join(small(plan, 10_000).alias("p"), F.expr("d.source <=> p.source"))
    joined = joined.withColumn("times", times(key, F.col("d.doc_id"), size)).where("times > 0")
    return joined.withColumn("copy", F.explode(F.expr("sequence(1L, times)"))).select("d.*")
