"""Benchmark decontamination by edit matching: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies.

A test item of n characters may appear with up to n * BUDGET // 100 edits. Cut into one piece more than that, at least
one piece of any such appearance is exact. One Aho-Corasick automaton finds all exact pieces of all items in a single
pass over each whole text; where a piece hits, the stretch of text that the item could occupy is verified.

Texts and items are compared in NFC, lower case, with every run of other than letters and digits as one space. The test
items are a stated query set: they are sent to the executors in groups of at most `GROUP_BYTES` of text, one pass over
the documents for each group, so memory stays bounded however many there are.

Defined results: null, empty or wordless texts and items match nothing; items shorter than 100 / BUDGET characters must
appear exactly, as whole words; repeated documents each get their hits, repeated item ids count as items; empty tables
give no hits; other columns pass through `drop_contaminated` and are ignored elsewhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 6
GROUP_BYTES = 16 << 20
HITS = "doc_id long, item_id long, distance int, start long, stop long"
_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """With a space at either end, so that whole words can be asked for."""
    return f" {_GAPS.sub(' ', unicodedata.normalize('NFC', text or '').lower()).strip()} "


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length and their places in item."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item, ready for Myers' algorithm: bit i of masks[c] says that character i is c."""

    def __init__(self, item: str):
        self.item, self.errors = item, len(item) * BUDGET // 100
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def nearest(self, text: str) -> tuple[int, int]:
        """The least distance to any substring of text, and where the first such substring ends."""
        top, full = 1 << (len(self.item) - 1), (1 << len(self.item)) - 1
        plus, minus, score = full, 0, len(self.item)
        best, end, masks = score, 0, self.masks
        for at, c in enumerate(text, 1):
            equal = masks.get(c, 0)
            vertical = equal | minus
            across = ((((equal & plus) + plus) & full) ^ plus) | equal
            rise, fall = minus | (full & ~(across | plus)), plus & across
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
            rise, fall = (rise << 1) & full, (fall << 1) & full
            plus, minus = fall | (full & ~(vertical | rise)), rise & vertical
            if score < best:
                best, end = score, at
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.patterns = [Pattern(x) for _, x in items]
        where = defaultdict(list)
        for k, p in enumerate(self.patterns):
            for at, piece in pieces(p.item, p.errors):
                where[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, stop) of the best appearance of each item in a normal text; start allows for the errors."""
        if not self.patterns:
            return []
        spans = defaultdict(list)
        for last, (length, uses) in self.automaton.iter(text):
            for k, at in uses:
                p = self.patterns[k]
                first = last + 1 - length - at
                spans[k].append((max(0, first - p.errors), min(len(text), first + len(p.item) + p.errors)))
        found = []
        for k, of in spans.items():
            p, best = self.patterns[k], None
            for a, b in merged(of):
                if p.item in text[a:b]:
                    end = text.index(p.item, a, b) + len(p.item)
                    best = (0, end)
                    break
                distance, end = p.nearest(text[a:b])
                if distance <= p.errors and (best is None or distance < best[0]):
                    best = (distance, a + end)
            if best:
                found.append((k, best[0], max(0, best[1] - len(p.item) - best[0]), best[1]))
        return found


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    start = stop = None
    for a, b in sorted(spans):
        if start is None or a > stop:
            if start is not None:
                yield start, stop
            start, stop = a, b
        stop = max(stop, b)
    if start is not None:
        yield start, stop


def item_groups(benchmark: DataFrame) -> list[list[tuple[int | None, str]]]:
    """The test items in groups of bounded text; a group is what one pass broadcasts."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // GROUP_BYTES) or 1
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    groups = ([(r["item_id"], x) for r in items.where(bucket == k).collect() if len(x := normal(r["text"])) > 2] for k in range(parts))
    return [g for g in groups if g]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start, stop) for every item that appears in a document; places in the normal text."""
    spark = docs.sparkSession
    out = None
    for group in item_groups(benchmark):
        sent = spark.sparkContext.broadcast(group)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                rows = [
                    (doc_id, matcher.ids[k], distance, start, stop)
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    for k, distance, start, stop in matcher.hits(normal(text.as_py()))
                ]
                names = ("doc_id", "item_id", "distance", "start", "stop")
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        hits = docs.select("doc_id", "text").mapInArrow(scan, HITS)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], HITS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item appears, all their columns; each row is judged where it lies, without a join."""
    spark = docs.sparkSession
    for group in item_groups(benchmark):
        sent = spark.sparkContext.broadcast(group)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(normal(text.as_py())) for text in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
