"""Quality rules: per-text counts, then robust multivariate outliers per language and source; DataFrame operations only.

Each text gives a vector of transformed statistics. For every (lang, source) the minimum-covariance-determinant estimate
of centre and scatter is searched from eight deterministic starts, all centred on the medians: quartile ranges alone, these
with the correlations of tanh-scaled rows or of spatial signs, and these with one coordinate four times as narrow. On made
groups of 16 and 40 rows they find the least determinant in five of six, the first three in little over half. A concentration step keeps the share `SUPPORT` of
rows nearest to an estimate and re-estimates from those. Every start takes `FIRST_STEPS` steps; the one of the least
determinant goes on until no group's determinant changes any more. Last, the estimate is made once more from all rows
inside the chi-square quantile `INSIDE`. A document whose squared Mahalanobis distance exceeds the quantile 1 - `TAIL` of
chi-square with five degrees is rejected.

Groups of fewer than `GROUP_ROWS` rows that pass the base rule are pooled by language, and what is left of small pools is
one more pool, whatever its size: nothing goes unjudged. Where texts hardly vary (most have no symbols at all), a coordinate's
scatter is raised to the square of its `FLOOR`; larger ones stay as estimated.

Rows are never ordered or gathered: one step is one aggregation of moments per (group, bin of distance), so a group may
hold any share of the rows; the share kept is rounded up to the end of its bin (a 256th of an octave, a 32nd while all starts
are tried). The statistics
are integers and the sums decimals, so reruns agree to the last bit.

Defined results: null and empty texts have no words and fail the base rule; nulls in lang or source are groups of their
own; ties in distance share a bin and stay together; repeated rows count as rows; an empty table gives an empty result;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, discard, small

#: Share of a group's rows that the estimate rests on; quantile of the rows that the last one is made from; share of normal rows beyond the cut-off.
SUPPORT, INSIDE, TAIL = 0.75, 0.975, 1e-6
FIRST_STEPS, MOST_STEPS = 2, 12
#: Rows that a group needs for an estimate of its own.
GROUP_ROWS = 40
#: Fixed point of the statistics; bins of distance to an octave.
ONE, BINS, FIRST_BINS = 1024, 256, 32
#: Least standard deviations: word length, and logarithms of the rates of symbols, capitals, marks, repeated words.
FLOOR = (0.25, 0.5, 0.25, 0.25, 0.5)
#: Rates are smoothed by so many words of usual text, so that short texts don't stand out by chance.
USUAL = 20
DIM = range(len(FLOOR))
PAIRS = [(i, j) for i in DIM for j in range(i + 1)]
#: Names of the starts: correlations, or the coordinate by which rows are near above all.
STARTS = ("quartiles", "tanh", "signs", *[f"by{i}" for i in DIM])


def chi5(x: float, extra: bool = False) -> float:
    """Chi-square distribution with five degrees, or with seven."""
    five = math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    return five - math.sqrt(2 / math.pi) * x**2.5 * math.exp(-x / 2) / 15 if extra else five


def quantile(share: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi5(mid) < share else (low, mid)
    return low


def consistent(share: float) -> float:
    """The factor by which the scatter of that share of normal rows falls short."""
    return share / chi5(quantile(share), True)


CUTOFF = quantile(1 - TAIL)


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks (long) of its text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = F.translate(t, "\t\n\x0b\x0c\r", "     ")
    df = df.withColumn("_words", F.array_remove(F.split(spaced, " "), ""))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # A five-word window is known by a 64-bit hash, chained over its words.
    windows = F.expr(
        "CASE WHEN size(_words) > 5 THEN transform(sequence(0, size(_words) - 5), "
        "i -> xxhash64(_words[i], _words[i+1], _words[i+2], _words[i+3], _words[i+4])) END"
    )
    df = df.withColumn("_windows", windows)
    again = F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END")
    df = df.withColumn("_sorted", again)
    # Equal windows are neighbours now; their places, in order, cover five words each.
    places = F.expr(
        "array_sort(transform(filter(_sorted, (x, k) -> (k > 0 AND _sorted[k-1].h = x.h) "
        "OR (k + 1 < size(_sorted) AND _sorted[k+1].h = x.h)), x -> x.i))"
    )
    df = df.withColumn("_places", places)
    covered = F.expr("aggregate(_places, struct(-5 AS last, 0 AS n), (a, p) -> struct(p AS last, a.n + least(5, p - a.last) AS n), a -> a.n)")
    return df.select(
        *[c for c in df.columns if c not in ("_words", "_lines", "_windows", "_sorted", "_places")],
        F.size("_words").cast("long").alias("n_words"),
        F.expr("aggregate(_words, 0L, (a, w) -> a + char_length(w))").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[.,;:!?]")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """Mean word length, and logarithms of the rates of symbols, capitals, marks and repeated words; smoothed, fixed point."""
    words, chars = F.col("n_words") + USUAL, F.col("word_chars") + 5 * USUAL
    rates = [
        chars / words,
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(100 * (F.col("n_upper") + 0.075 * USUAL) / chars),
        F.log1p(100 * (F.col("n_marks") + 0.13 * USUAL) / words),
        F.log1p(100 * F.col("n_repeat_words") / words),
    ]
    return [F.round(F.least(x, F.lit(1000.0)) * ONE).cast("long").alias(f"v{i}") for i, x in enumerate(rates)]


def grouped(rows: DataFrame) -> DataFrame:
    """The group that each (lang, source) belongs to, by its usable rows: itself, the small ones of its language, or the rest."""
    counts = rows.groupBy("lang", "source").agg(F.count(F.when(~base_failed(), 1)).alias("n"))
    pooled = F.sum(F.when(F.col("n") < GROUP_ROWS, F.col("n"))).over(Window.partitionBy("lang"))
    level = F.when(F.col("n") >= GROUP_ROWS, 0).when(pooled >= GROUP_ROWS, 1).otherwise(2)
    leveled = counts.withColumn("level", level)
    lang, source = F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") < 1, F.col("source"))
    return leveled.select("lang", "source", F.xxhash64("level", lang, lang.isNull(), source, source.isNull()).alias("grp"))


def usable(light: DataFrame, groups: DataFrame) -> DataFrame:
    """grp and the vector of every row that passes the base rule."""
    return with_group(light.where(~base_failed()).select("lang", "source", *vector()), groups).drop("lang", "source")


def with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    on = F.expr("r.lang <=> g.lang AND r.source <=> g.source")
    return rows.alias("r").join(small(groups, 20_000).alias("g"), on, "left").select("r.*", "g.grp")


def quartiles(rows: DataFrame) -> DataFrame:
    """Medians and the quartile range's deviation, by coordinate: from counts of values cut to sixteenths of a floor's unit."""
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"v{i}") / (ONE // 64)).alias("b")) for i in DIM])
    counts = rows.select("grp", F.explode(values).alias("x")).groupBy("grp", "x.i", "x.b").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("grp", "i")
    share = counts.withColumn("upto", F.sum("n").over(whole.orderBy("b"))).withColumn("all", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("b") + 0.5)) / 64
    by = share.groupBy("grp", "i").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("dev"))
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    return by.groupBy("grp").agg(*[of(i, "mid").alias(f"m{i}") for i in DIM], *[of(i, "dev").alias(f"q{i}") for i in DIM])


def first_estimates(rows: DataFrame) -> DataFrame:
    """Every start of every group: the medians, and a scatter made of the quartile ranges."""
    middle = cut(quartiles(rows).coalesce(1), "quality-quartiles")
    z = rows.join(small(middle, 20_000), "grp")
    for i in DIM:
        z = z.withColumn(f"z{i}", (F.col(f"v{i}") / ONE - F.col(f"m{i}")) / F.greatest(F.col(f"q{i}"), F.lit(FLOOR[i])))
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in DIM), F.lit(1e-12)))
    fixed = lambda c: F.round(c * ONE).cast("long")
    scaled = {"tanh": lambda i: fixed(F.tanh(f"z{i}")), "signs": lambda i: fixed(F.col(f"z{i}") / norm)}
    z = z.select("grp", *[f(i).alias(f"{k}{i}") for k, f in scaled.items() for i in DIM])
    moments = z.groupBy("grp").agg(*[F.sum((F.col(f"{k}{i}") * F.col(f"{k}{j}")).cast("decimal(20,0)")).cast("double").alias(f"{k}{i}{j}") for k in scaled for i, j in PAIRS])
    found = middle.join(small(moments, 20_000), "grp")

    def entry(kind: str, i: int, j: int) -> Column:
        if i == j:
            return F.col(f"q{i}") * F.col(f"q{i}") / (16 if kind == f"by{i}" else 1)
        if kind not in scaled:
            return F.lit(0.0)
        scale = F.sqrt(F.col(f"{kind}{i}{i}") * F.col(f"{kind}{j}{j}"))
        return F.col(f"q{i}") * F.col(f"q{j}") * F.when(scale > 0, F.col(f"{kind}{i}{j}") / scale).otherwise(0.0)

    starts = [F.struct(F.lit(k).alias("start"), *[F.col(f"m{i}") for i in DIM], *[entry(k, i, j).alias(f"c{i}{j}") for i, j in PAIRS]) for k in STARTS]
    out = cut(factored(found.select("grp", F.explode(F.array(*starts)).alias("x")).select("grp", "x.*")).coalesce(1), "quality-starts")
    discard(middle)
    return out


def factored(estimate: DataFrame) -> DataFrame:
    """The lower Cholesky factor of the scatter, its diagonal raised to the floors, and the logarithm of its determinant."""
    out = estimate
    for j in DIM:
        below = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        raised = F.greatest(F.col(f"c{j}{j}"), F.lit(FLOOR[j] ** 2))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(raised - below, F.lit(1e-9))))
        for i in range(j + 1, len(FLOOR)):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - dot) / F.col(f"l{j}{j}"))
    return out.withColumn("det", F.round(2 * sum((F.log(f"l{j}{j}") for j in DIM), F.lit(0.0)), 9))


def distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows with grp, for every start of it: d2, the squared Mahalanobis distance, the norm of the forward-solved residual."""
    wanted = [*[f"m{i}" for i in DIM], *[f"l{i}{j}" for i, j in PAIRS]]
    joined = rows.join(small(estimate.select("grp", "start", *wanted), 20_000), "grp", "left")
    for i in DIM:
        dot = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"y{i}", (F.col(f"v{i}") / ONE - F.col(f"m{i}") - dot) / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in DIM), F.lit(0.0))
    return joined.withColumn("d2", d2).drop(*[f"y{i}" for i in DIM], *wanted)


def moments(near: DataFrame, *keys: str) -> DataFrame:
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    return near.groupBy("grp", "start", *keys).agg(
        F.count("*").alias("n"),
        *[exact(F.col(f"v{i}")).alias(f"s{i}") for i in DIM],
        *[exact(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}{j}") for i, j in PAIRS],
    )


def estimated(sums: DataFrame, share: float) -> DataFrame:
    """Centre and factored scatter from moments."""
    kept = sums.select("grp", "start", *[F.col(c).cast("double").alias(c) for c in ("n", *[f"s{i}" for i in DIM], *[f"p{i}{j}" for i, j in PAIRS])])
    cov = lambda i, j: consistent(share) * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) / (ONE * ONE)
    centre = [(F.col(f"s{i}") / F.col("n") / ONE).alias(f"m{i}") for i in DIM]
    return factored(kept.select("grp", "start", *centre, *[cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS]))


def concentrate(rows: DataFrame, estimate: DataFrame, bins: int = BINS) -> DataFrame:
    """One concentration step: centre and scatter of the nearest share of each group, for every start."""
    near = distance(rows, estimate).withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * bins))
    sums = moments(near, "bin")
    whole = Window.partitionBy("grp", "start")
    ranked = sums.withColumn("before", F.sum("n").over(whole.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(whole))
    columns = ["n", *[f"s{i}" for i in DIM], *[f"p{i}{j}" for i, j in PAIRS]]
    kept = ranked.where(F.col("before") < F.ceil(SUPPORT * F.col("all"))).groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in columns])
    return cut(estimated(kept, SUPPORT).coalesce(1), "quality-step")


def best(estimate: DataFrame) -> DataFrame:
    """Of each group the start of the least determinant; the first of equals."""
    names = estimate.columns
    least = F.min_by(F.struct(*names), F.struct("det", "start")).alias("x")
    return estimate.groupBy("grp").agg(least).select(*[f"x.{c}" for c in names])


def estimates(light: DataFrame, groups: DataFrame) -> DataFrame:
    """Centre and factored scatter per group, from the rows that pass the base rule."""
    rows = usable(light, groups)
    found = first_estimates(rows)
    for _ in range(FIRST_STEPS):
        found, old = concentrate(rows, found, FIRST_BINS), found
        discard(old)
    found, old = cut(best(found).coalesce(1), "quality-best"), found
    discard(old)
    for _ in range(MOST_STEPS):
        found, old = concentrate(rows, found), found
        moved = found.join(old.select("grp", F.col("det").alias("before")), "grp").where("det <> before").limit(1).count()
        discard(old)
        if not moved:
            break
    inside = moments(distance(rows, found).where(F.col("d2") <= quantile(INSIDE)))
    last = cut(estimated(inside, INSIDE).coalesce(1), "quality-last")
    discard(found)
    return last


def verdict() -> Column:
    return ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)


def scored(light: DataFrame) -> DataFrame:
    """A cut of counted documents with base_failed, d2 and kept."""
    groups = cut(grouped(light).coalesce(1), "quality-groups")
    rows = with_group(light.withColumn("base_failed", base_failed()).select("*", *vector()), groups)
    out = distance(rows, estimates(light, groups)).withColumn("kept", verdict())
    return out.drop("grp", "start", *[f"v{i}" for i in DIM])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, d2 and kept of every document."""
    return scored(cut(text_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-counts"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all their columns. The counted documents are cut once, so each text is counted once and none is shuffled."""
    whole = docs.select(F.struct("*").alias("doc")).select("doc", "doc.lang", "doc.source", F.col("doc.text").alias("text"))
    counted = cut(text_counts(whole).drop("text"), "quality-counted", compression="zstd")
    return scored(counted).where("kept").select("doc.*")
