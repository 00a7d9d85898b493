"""Near-duplicate documents by MinHash and an LSH forest.

A text's set holds the distinct shingles of so many words; equal sets form one class, and one signature of `SLOTS`
MinHash values stands for it. The forest is `TREES` orders of all classes, each sorted by another sequence of slots, so
that neighbours have the longest common prefix. Classes that agree on the first `DEPTH` slots of an order form a region.

1. The depth adapts to each region: one of more than `CROWD` classes is split by its next slot, and its parts again,
   until a part has `CROWD` classes at most or `DEEPER` slots more are used up. All pairs of a part are candidates, and in
   split regions every class and its neighbour in the order too. Regions beyond `PART_ROWS` classes are dealt to several tasks. Of the candidates that look similar by signature a class
   first verifies the `NEAREST` most similar ones.
2. A split region gets a hub, the class that most of its members meet in their largest regions; hubs needn't be
   members, so that one hub serves a whole family of copies. Every member is compared with its hub.
3. Verified links give components. Candidates that still join two components are verified next. What splitting may have
   parted is found exactly: of the members of one hub, x and y are linked if and only if their differences from the hub
   (sets, d elements each) share at least t = (9 (dx + dy) - (nx + ny)) / 18 elements (at 0.8). Whenever x isn't linked
   with the hub, t is positive, so both have a common element among the rarest d - t + 1 of their differences. Only
   such pairs are made, with x outside the hub's component; they are verified on full sets.

So every pair that shares a region in any order is either compared or proven unlike; no pair is dropped, and the pairs
made grow with the classes, not with the square of a region. A pair at similarity 0.8 shares no region with a probability
of about (1 - 0.8**5)**40 < 2e-7 (slots shared between orders raise that slightly). The signature filter asks for 82 of
128 equal slots, which such a pair misses with 8.7e-6: together about 1e-5.

Defined results: words are ASCII-lower-cased runs of non-white-space; texts with fewer words than a shingle are one
shingle; null or wordless texts have an empty set and link with nothing; rows without an id stand alone (component null,
kept); rows that repeat an id are one node; ties go to the smallest id; an empty table gives an empty result; other
columns pass through `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, discard, small
from tessera.llm.components import components

SLOTS, TREES, DEPTH, DEEPER = 128, 40, 5, 8
CROWD = 8
NEAREST = 2
SIMILAR = 0.8
LOOKS_SIMILAR = 0.64
#: Members that are compared with one copy of their hub's set; rows of one region that are split at once.
STAR_ROWS, HELD_ROWS = 256, 1 << 16
#: Classes of a region that one task sorts; classes that are drawn to find larger regions, which are dealt in parts.
PART_ROWS, DRAWN = 50_000, 20_000
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_ORDER = np.array([_rng.permutation(SLOTS)[: DEPTH + DEEPER] for _ in range(TREES)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    of = (text or "").encode().lower().split()
    if not of:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, of), np.uint64, len(of))
    length = min(size, len(h))
    out = np.full(len(h) - length + 1, length, np.uint64)
    for i in range(length):
        out = mixed(out * _BASE + h[i : len(h) - length + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS MinHash values, each folded to 16 bits."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _MUL + _ADD).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def node_of(hashes: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of its members."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes()))))


def sign(size: int):
    """mapInArrow: documents -> sizes, classes and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            counts, nodes, signs = [], [], []
            for text in batch.column("text"):
                hashes = shingles(text.as_py(), size, words)
                counts.append(len(hashes))
                nodes.append(node_of(hashes) if len(hashes) else None)
                signs.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "node", "signature"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: classes -> their place in every order: the region and the slots that follow, four to a number."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            slots = matrix(part.column("signature")).astype(np.uint64)
            for t, order in enumerate(_ORDER):
                region, deep = np.full(len(slots), t + 1, np.uint64), np.zeros((2, len(slots)), np.uint64)
                for s in order[:DEPTH]:
                    region = mixed(region * _BASE + slots[:, s])
                for k, s in enumerate(order[DEPTH:]):
                    deep[k // 4] = (deep[k // 4] << np.uint64(16)) | slots[:, s]
                columns = [pa.array(x.view(np.int64)) for x in (region, deep[0], deep[1])]
                yield pa.RecordBatch.from_arrays([*columns, part.column("node")], names=["region", "deep", "deeper", "node"])


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Of sorted places (region, deep, deeper, node): slots after the region that each shares with the one before; -1 across regions."""
    unlike = rows[:3, 1:] ^ rows[:3, :-1]
    out = np.full(rows.shape[1], -1)
    shared = np.full(rows.shape[1] - 1, DEEPER)
    for k in range(DEEPER - 1, -1, -1):
        slot = (unlike[1 + k // 4].view(np.uint64) >> np.uint64(48 - 16 * (k % 4))) & np.uint64(0xFFFF)
        shared[slot != 0] = k
    out[1:] = np.where(unlike[0] != 0, -1, shared)
    return out


def descend(rows: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted places: candidate pairs, and which rows are in a split region. goes_on: the first region began before."""
    shared = common_prefix(rows)
    node, count = rows[3], rows.shape[1]
    split = np.zeros(count, bool)
    active = np.ones(count, bool)
    left, right = [], []
    for depth in range(DEEPER + 1):
        run = np.cumsum(shared < depth) - (shared[0] < depth)
        size = np.bincount(run)[run]
        if not depth:
            split = (size > CROWD) | ((run == 0) & goes_on) | (rows[5] > 0)
            beside = np.flatnonzero(split[1:] & (run[1:] == run[:-1]))
            left.append(node[beside])
            right.append(node[beside + 1])
        here = active & (size <= CROWD) & (~split | (depth > 0))
        active &= ~here
        for step in range(1, CROWD):
            k = np.flatnonzero(here[:-step] & (run[step:] == run[:-step]))
            left.append(node[k])
            right.append(node[k + step])
    left, right = np.concatenate(left), np.concatenate(right)
    return np.minimum(left, right), np.maximum(left, right), split


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: sorted places -> candidate pairs (a, b), and (region, a) of the members of split regions.

    A region that goes on over HELD_ROWS rows is split in parts of so many, and one that is dealt in parts is split at once
    (part: its rows lie together; of: the region). That parts some pairs, which the hub finds.
    """
    columns = ("part", "deep", "deeper", "node", "of", "dealt")
    held, goes_on = np.zeros((len(columns), 0), np.int64), False
    for batch in chain(batches, [None]):
        if batch is not None:
            held = np.concatenate([held, [batch.column(c).to_numpy() for c in columns]], axis=1)
        if not held.shape[1]:
            continue
        last = int(np.searchsorted(held[0], held[0, -1])) if batch is not None else held.shape[1]
        inside = last == 0 and held.shape[1] > HELD_ROWS
        if not last and not inside:
            continue
        rows = held if inside else held[:, :last]
        a, b, split = descend(rows, goes_on)
        split[0] &= not goes_on  # its row has been given
        pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        pairs = pairs[:, pairs[0] != pairs[1]]
        none = pa.nulls(pairs.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(pairs[0]), pa.array(pairs[1])], names=["region", "a", "b"])
        none = pa.nulls(int(split.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows[4, split]), pa.array(rows[3, split]), none], names=["region", "a", "b"])
        held, goes_on = (held[:, -1:], True) if inside else (held[:, last:], False)


def forest(classes: DataFrame) -> DataFrame:
    """Candidate pairs and members of split regions, of all orders. A region too large for a task, as far as a draw of classes
    shows, is dealt in parts by a hash of its members; which regions that finds changes no result."""
    places = classes.mapInArrow(plant, "region long, deep long, deeper long, node long")
    count = classes.count()
    if count > PART_ROWS:
        share = min(1.0, DRAWN / count)
        drawn = classes.sample(share, seed=1).mapInArrow(plant, "region long, deep long, deeper long, node long")
        large = drawn.groupBy("region").agg(F.ceil(F.count("*") / share / PART_ROWS).cast("int").alias("parts")).where("parts > 1")
        large = cut(large, "near-large")  # TREES * count / PART_ROWS rows at most
        places = places.join(small(large, 1_000_000), "region", "left")
    else:
        places = places.withColumn("parts", F.lit(None).cast("int"))
    part = F.when(F.col("parts").isNull(), F.col("region")).otherwise(F.xxhash64("region", F.pmod(F.xxhash64("node"), F.col("parts"))))
    places = places.select(part.alias("part"), "deep", "deeper", "node", F.col("region").alias("of"), F.col("parts").isNotNull().cast("long").alias("dealt"))
    ordered = places.repartition("part").sortWithinPartitions("part", "deep", "deeper", "node")
    return cut(ordered.mapInArrow(neighbours, "region long, a long, b long"), "near-forest")


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: pairs with both signatures and sizes -> those that could be links, with the share of equal slots."""
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        share = (matrix(batch.column("sa")) == matrix(batch.column("sb"))).mean(1)
        keep = np.flatnonzero((share >= LOOKS_SIMILAR) & (np.minimum(na, nb) >= SIMILAR * np.maximum(na, nb) - 1e-9))
        ends = [batch.column(c).take(pa.array(keep)) for c in ("a", "b")]
        yield pa.RecordBatch.from_arrays([*ends, pa.array(share[keep])], names=["a", "b", "share"])


def to_sets(size: int):
    """mapInArrow: documents with the class they were found in -> that class's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            found = {}
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                hashes = shingles(text.as_py(), size, words)
                if len(hashes) and node_of(hashes) == node:
                    found[node] = hashes.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["node", "members"])

    return run


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Sorted rows (a, block, b, members), the centre first -> centre, its set, another class, its set."""
    centre, of = np.zeros(0, np.uint64), None
    for batch in batches:
        for a, b, members in zip(batch.column("a"), batch.column("b"), batch.column("members"), strict=True):
            held = np.frombuffer(members.as_py(), np.uint64)
            if not b.is_valid:
                centre, of = held, a.as_py()
            else:
                yield of, centre, b.as_py(), held


def linked(n: int, m: int, common: int) -> bool:
    return 100 * common >= round(100 * SIMILAR) * (n + m - common)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: stars -> their true links."""
    found: list[tuple[int, int]] = []
    for a, x, b, y in stars(batches):
        both = np.concatenate([x, y])
        both.sort()
        if linked(len(x), len(y), int((both[1:] == both[:-1]).sum())):
            found.append((a, b))
        if len(found) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: stars -> the sizes of both sets and the elements that only one of them has."""
    names = ["hub", "h", "node", "n", "apart"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    found: list[tuple] = []
    held = 0
    for a, x, b, y in stars(batches):
        apart = np.setxor1d(x, y, assume_unique=True).view(np.int64)
        found.append((a, len(x), b, len(y), apart))
        held += len(apart)
        if held >= 500_000 or len(found) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
            found, held = [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def with_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda p: classes.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("signature").alias(f"s{p}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) as stars: rows (a, block, b, members) sorted within partitions, a's own set first in each block of STAR_ROWS."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).alias("blocks"))
    dealt = pairs.select("a", "b").join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    others = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "members")
    centres = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    rows = others.unionByName(centres.select("a", "block", F.lit(None).cast("long").alias("b"), "members"))
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))


def true_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the candidate pairs whose full sets are similar enough."""
    return with_sets(pairs, sets).mapInArrow(verify, "a long, b long")


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The full sets of so many classes, made again from the texts."""
    needed = cut(nodes.distinct().join(classes.select("node", "doc_id"), "node"), "near-needed")
    texts = docs.select("doc_id", "text").join(small(needed, 500_000), "doc_id").select("node", "text")
    return cut(texts.mapInArrow(to_sets(size), "node long, members binary").dropDuplicates(["node"]), "near-sets")


def families(crowds: DataFrame) -> DataFrame:
    """Members of split regions (region, node) -> (a, b): hub and member, such that two members of a region share a hub."""
    of_region = lambda df, name: small(cut(df, name), 1_000_000)  # noqa: E731  narrow rows, so that members needn't meet by region
    sizes = of_region(crowds.groupBy("region").agg(F.count("*").alias("m")), "near-sizes")
    score = crowds.join(sizes, "region").groupBy("node").agg(F.sum("m").alias("score"))
    scored = cut(crowds.join(score, "node"), "near-scored")
    own = of_region(scored.groupBy("region").agg(F.max(F.struct("score", "node")).alias("best")), "near-own")
    # The best hub that a class meets; then the one that most members of a region agree upon.
    meets = scored.join(own, "region").groupBy("node").agg(F.max("best").alias("best"))
    votes = scored.select("region", "node").join(meets, "node").groupBy("region", "best").agg(F.count("*").alias("n"))
    hubs = votes.groupBy("region").agg(F.max(F.struct("n", "best")).alias("x")).select("region", F.col("x.best.node").alias("a"))
    return scored.join(of_region(hubs, "near-region-hubs"), "region").select("a", F.col("node").alias("b")).where("a <> b").distinct()


def parted(stars_: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate pairs of members of one hub, one of them outside the hub's component, by their differences from the hub."""
    root = found.select("node", "root")
    hubs = stars_.select("a").distinct().join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    placed = stars_.join(small(cut(hubs, "near-hub-roots"), 1_000_000), "a")  # members needn't meet by hub
    placed = placed.join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    placed = placed.select("a", "b", (F.coalesce("ra", "a") != F.coalesce("rb", "b")).alias("free"))
    open_ = placed.where("free").select("a").distinct()
    placed = cut(placed.join(open_, "a"), "near-open")
    apart = cut(with_sets(placed, sets).mapInArrow(differences, "hub long, h long, node long, n long, apart array<long>"), "near-apart")
    free = placed.select(F.col("a").alias("hub"), F.col("b").alias("node"), "free")
    apart = apart.join(free, ["hub", "node"]).withColumn("d", F.size("apart").cast("long"))
    # The least share with any partner that could be a link: of a free one with any, of another with a free one.
    least = F.when(F.col("free"), F.expr("9 * d - n - h")).otherwise(F.expr("9 * d - n + h + 1"))
    apart = apart.withColumn("t", F.greatest(F.lit(1), F.ceil(least / 18)).cast("long"))
    each = cut(apart.select("hub", "node", "n", "d", "t", "free", F.explode("apart").alias("x")), "near-elements")
    common = each.groupBy("hub", "x").agg(F.count("*").alias("m")).where("m > 1")
    rows = each.join(common, ["hub", "x"]).groupBy("hub", "node", "n", "d", "t", "free").agg(F.array_sort(F.collect_list(F.struct("m", "x"))).alias("xs"))
    # Elements of one member only come first and meet nothing: the others' places follow theirs.
    rows = rows.select("hub", "node", "n", "d", "t", "free", F.expr("d - size(xs)").alias("alone"), F.posexplode("xs").alias("at", "e"))
    rows = rows.select("hub", "e.x", "node", "n", "d", "t", "free", (F.col("alone") + F.col("at")).alias("at")).where("at <= d - t")
    rows = cut(rows, "near-rare")
    x, y = rows.where("free").alias("x"), rows.alias("y")
    shared = F.expr("greatest(1, ceil((9 * (x.d + y.d) - (x.n + y.n)) / 18))")
    on = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.x") == F.col("y.x")) & (F.expr("NOT y.free OR x.node < y.node"))
    on = on & (F.expr("least(x.d - x.at, y.d - y.at)") >= shared)
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def label(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = docs.select("doc_id", "text").mapInArrow(sign(size), "doc_id long, n_shingles long, node long, signature binary")
    signed = cut(signed, "near-signed")
    linkable = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = linkable.groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x"), F.count("*").alias("copies"))
    classes = cut(classes.select("node", "x.doc_id", F.col("x.n_shingles").alias("n"), "x.signature", "copies"), "near-classes")
    grown = forest(classes)

    pairs = grown.where("region IS NULL").select("a", "b").distinct()
    likely = cut(with_signatures(pairs, classes).mapInArrow(similar, "a long, b long, share double"), "near-likely")
    hubs = cut(families(grown.where("region IS NOT NULL").select("region", F.col("a").alias("node"))), "near-hubs")
    sets = sets_of(docs, classes, likely.unionByName(hubs, True).select(F.explode(F.array("a", "b")).alias("node")), size)
    ends = likely.select("a", "b", "share", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("share"), "a", "b"))
    nearest = ends.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("a", "b")
    first = cut(nearest.unionByName(hubs).distinct(), "near-first")

    # An id that repeats with other texts ties its classes together.
    ids = linkable.select("doc_id", "node")
    repeats = ids.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    tied = ids.join(repeats, "doc_id").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    found = cut(components(true_links(first, sets).unionByName(tied)), "near-found")

    root = lambda p: found.select(F.col("node").alias(p), F.col("root").alias(f"r{p}"))
    across = likely.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
    across = across.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest = cut(across.unionByName(parted(hubs, sets, found)).distinct(), "near-rest")
    more = cut(true_links(rest, sets), "near-more")
    if more.limit(1).count():
        found = cut(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "near-found")
    discard(grown, likely, hubs, sets, first, rest, more)

    named = classes.select("node", "doc_id").join(found, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = found.join(named, "root").select("node", "component_id")
    names = classes.select("node", "doc_id", "copies").join(joined, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    # A document alone in its class and its component has its own name; the others' names are few enough to go to the documents, mostly.
    names = cut(names.where("copies > 1 OR component_id <> doc_id").select("node", "component_id"), "near-names")
    out = signed.drop("signature").join(small(names, 1_000_000), "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs without the near copies: of every component the rows of its smallest id stay, all their columns."""
    gone = cut(label(docs, size).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return docs.join(small(gone, 2_000_000), "doc_id", "left_anti").select(docs.columns)
