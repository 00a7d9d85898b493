"""Repeated passages: bytes covered by a 100-byte string that starts earlier too, found by bucket-pointer refinement.

1. Every 100-byte string has an anchor: the first of its 50-byte grams with the least hash. Strings with one anchor in
   one place form a run; equal strings have equal anchors, so only runs of equal anchors can hold equal strings.
2. Runs go to buckets by anchor. Equal runs are settled there at once: all but the first are repeats. Runs that differ
   though their anchor is equal (the ends of passages, edits) ask for their bytes.
3. For those, suffixes are sorted by bucket-pointer refinement: buckets of 4-byte grams, refined by sorting on the
   bucket identifiers at later offsets, 4 + 4, 8 + 8, 16 + 9, 25 + 25, 50 + 50; a place alone in its bucket is settled
   and drops out, and the identifiers of each round serve the next. Bucket mates at depth 100 are equal strings; all but
   the first are repeats.
4. The covered bytes of each document are merged, cut out and described.

An anchor with more than HOT_RUNS unlike runs (a phrase of 50 bytes in many contexts) is split: strings whose anchor lies
within the same RANGES-th of the possible offsets all hold the same core of 88 bytes or more, so only runs with equal
cores can hold equal strings, and these meet by core instead.

Hashes of 64 bits only route; runs are equal by 112 bits of independent hashes, strings by their bytes. Map tasks settle
equal runs among their own documents before the shuffle, so a passage that many documents share leaves each task once.
A bucket's and a batch's memory are bounded; of a very frequent anchor the runs are taken in document order, batch after
batch, and only the runs that held a first occurrence stay for the next batch.

Defined results: texts are UTF-8 bytes, null is empty; a text under 100 bytes has no repeats and gives none; rows that
repeat an id and text are one document, rows that repeat an id with other texts are ordered by a hash of the text; null
ids come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, small

LENGTH, GRAM = 100, 50
SLICE = 1 << 20
BUCKET_BYTES = 16 << 20
BATCH = 1 << 20
RUNS = 1 << 18
HOT_RUNS, RANGES = 256, 4
_rng = np.random.default_rng(31)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = 0xD6E8FEB86659FD93
_POW = {k: np.uint64(pow(_B, k, 1 << 64)) for k in (1, 2, 4, 8, 16, 18, 32)}
PIECES = "bucket int, doc long, tie int, blob binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every 50-byte gram, by doubling."""
    h, kept = _BYTE[data], {}
    for size in (1, 2, 4, 8, 16):
        kept[size] = h
        h = h[:-size] * _POW[size] + h[size:]
    n = len(data) - GRAM + 1
    return _mixed((h[:n] * _POW[16] + kept[16][32 : 32 + n]) * _POW[2] + kept[2][48 : 48 + n])


def runs(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, run hash, place of the anchor, strings before it (lead) and strings but one (span) of every run."""
    h = gram_hashes(data)
    best, at = h, np.arange(len(h), dtype=np.int32)
    for step in (1, 2, 4, 8, 16):
        left = best[:-step] <= best[step:]
        best, at = np.where(left, best[:-step], best[step:]), np.where(left, at[:-step], at[step:])
    shift = LENGTH - GRAM + 1 - 32
    left = best[:-shift] <= best[shift:]
    at = np.where(left, at[:-shift], at[shift:])
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    anchor = at[first].astype(np.int64)
    lead, span = anchor - first, last - first
    # Three grams cover the run's bytes, which are 150 at most.
    whole = _mixed(_mixed(h[first] * _POW[18] + h[np.minimum(first + GRAM, last + GRAM)]) + h[last + GRAM] * _POW[4] + (lead * 64 + span).astype(np.uint64))
    return h[anchor], whole >> np.uint64(16), anchor, lead, span


def packed(tie, anchor, lead, span) -> np.ndarray:
    return (np.int64(tie) << np.int64(43)) | (anchor << 12) | (lead << 6) | span


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tie, start and end of the bytes that the run's strings cover."""
    start = ((p >> 12) & ((1 << 31) - 1)) - ((p >> 6) & 63)
    return p >> 43, start, start + (p & 63) + LENGTH


def split_heads(h: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """All in the order of (anchor, run, document, place); whether each is the first of its run, and whether it repeats that."""
    order = np.lexsort((place, doc, whole, h))
    h, whole, doc, place = h[order], whole[order], doc[order], place[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    repeats = ~head & ((doc != doc[first]) | (place != place[first]))
    return h, whole, doc, place, head, repeats


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals as one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]]) if len(start) else np.zeros(0, bool)
    return start[new], stop[np.concatenate([new[1:], [True]])] if len(start) else stop


def pieces(kind: int | np.ndarray, doc: np.ndarray, tie: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, doc, tie, blob): the values of each document as one blob."""
    order = np.lexsort((tie, doc))
    doc, tie, values = doc[order], tie[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])) if len(doc) else np.zeros(0, np.int64)
    ends = [*new[1:].tolist(), len(doc)]
    for at in range(0, len(new), 5000):
        rows = [values[a:b].tobytes() for a, b in zip(new[at : at + 5000].tolist(), ends[at : at + 5000], strict=True)]
        where = new[at : at + 5000]
        buckets = np.full(len(where), kind, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(doc[where]), pa.array(tie[where].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "doc", "tie", "blob"])


def covered(doc: np.ndarray, place: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """The intervals of repeated runs, by document."""
    tie, start, stop = unpacked(place)
    yield from pieces(kind, doc, tie, np.column_stack([start, stop]))


def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def from_planes(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel(), at + n * width


def find_runs(buckets: int):
    """mapInArrow: documents -> first runs by bucket (bucket >= 0) and the intervals that repeat within the batch (bucket < 0: -1 - a bucket to travel with)."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, whole, doc, place = (np.concatenate(c) for c in zip(*held, strict=True))
        h, whole, doc, place, head, repeats = split_heads(h, whole, doc, place)
        yield from covered(doc[repeats], place[repeats], -1)
        h, whole, doc, place = h[head], whole[head], doc[head], place[head]
        goes = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(goes, kind="stable")
        bounds = np.searchsorted(goes[order], np.arange(buckets + 1))
        for b in range(buckets):
            mine = order[bounds[b] : bounds[b + 1]]
            if len(mine):
                blob = zstandard.compress(np.int64(len(mine)).tobytes() + planes(h[mine]) + planes(whole[mine]) + planes(doc[mine]) + planes(place[mine]), 1)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "doc", "tie", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text"), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for at in range(0, max(0, len(data) - LENGTH + 1), SLICE):
                    h, whole, anchor, lead, span = runs(data[at : at + SLICE + LENGTH - 1])
                    held.append((h, whole, np.full(len(h), doc, np.int64), packed(tie, anchor + at, lead, span)))
                    size += len(h)
                    if size > RUNS:
                        yield from settle(held)
                        held, size = [], 0
        if held:
            yield from settle(held)

    return run


def settle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: rows sorted by bucket -> repeated intervals (bucket 0), and runs that must show their bytes (1; 2: by cores)."""

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = []
        for blob in blobs:
            data = zstandard.decompress(blob)
            n, at, part = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
            for kind in ("<u8", "<u8", "<i8", "<i8"):
                column, at = from_planes(data, at, n, kind)
                part.append(column)
            parts.append(part)
        h, whole, doc, place, head, repeats = split_heads(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield from covered(doc[repeats], place[repeats], 0)
        h, doc, place = h[head], doc[head], place[head]
        same = h[1:] == h[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        h, doc, place = h[several], doc[several], place[several]
        _, which, unlike = np.unique(h, return_inverse=True, return_counts=True)
        hot = unlike[which] > HOT_RUNS
        for kind, mine in ((1, ~hot), (2, hot)):
            yield from pieces(kind, doc[mine], place[mine] >> 43, np.column_stack([h[mine].view(np.int64), place[mine]]))

    blobs, bucket = [], None
    for batch in batches:
        which = batch.column("bucket").to_numpy()
        through = np.flatnonzero(which < 0)
        if len(through):
            passed = batch.take(pa.array(through))
            yield passed.set_column(0, "bucket", pa.array(np.zeros(len(through), np.int32)))
        for k in np.flatnonzero(which >= 0).tolist():
            if which[k] != bucket and blobs:
                yield from settle(blobs)
                blobs = []
            bucket = which[k]
            blobs.append(batch.column("blob")[k].as_py())
    if blobs:
        yield from settle(blobs)


def by_cores(data: bytes, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut by where their strings hold the anchor: the hash of the core that all strings of such a part hold, and its place."""
    tie, start, _ = unpacked(place)
    anchor, lead, span = (place >> 12) & ((1 << 31) - 1), (place >> 6) & 63, place & 63
    most = LENGTH - GRAM
    cores, parts = [], []
    for k in range(RANGES):
        low, high = k * (most + 1) // RANGES, (k + 1) * (most + 1) // RANGES - 1
        first, last = np.minimum(lead, high), np.maximum(lead - span, low)
        some = first >= last
        parts.append(packed(0, anchor[some], first[some], first[some] - last[some]) | (tie[some] << 43))
        begin = anchor[some] - low
        cores.append(np.array([xxhash.xxh64_intdigest(data[c : c + LENGTH - high + low], k) for c in begin.tolist()], np.uint64).view(np.int64))
    return np.concatenate(cores), np.concatenate(parts)


def show_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: documents with the runs asked of them (kind, pairs of anchor and place) -> (anchor or core, doc, place, bytes)."""
    held: list[tuple] = []
    size = 0

    def shown() -> pa.RecordBatch:
        anchor, doc, place = (np.concatenate([h[i] for h in held]) for i in range(3))
        bytes_ = pa.array([x for h in held for x in h[3]], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(place), bytes_], names=["anchor", "doc", "place", "bytes"])

    for batch in batches:
        for doc, text, asked in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("blobs").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            for ask in asked:
                anchor, place = np.frombuffer(ask["blob"], np.int64).reshape(-1, 2).T
                if ask["bucket"] == 2:
                    anchor, place = by_cores(data, place)
                _, start, stop = unpacked(place)
                held.append((anchor, np.full(len(place), doc, np.int64), place, [data[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]))
                size += len(place)
            if size > 10_000:
                yield shown()
                held, size = [], 0
    if held:
        yield shown()


def refine(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Bucket identifiers at depth 100 of the wanted places: equal identifiers, equal strings. Suffixes end in zeros beyond the text."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)]).astype(np.uint32)
    bucket = ((padded[:n] << 24) | (padded[1 : n + 1] << 16) | (padded[2 : n + 2] << 8) | padded[3 : n + 3]).astype(np.int64)
    _, bucket = np.unique(bucket, return_inverse=True)
    depth = 4
    # Which places each depth needs, from the last refinement backwards.
    needs = {LENGTH: wanted}
    for d, step in ((50, 50), (25, 25), (16, 9), (8, 8)):
        above = needs[{50: 100, 25: 50, 16: 25, 8: 16}[d]]
        mark = np.zeros(n + LENGTH, bool)
        mark[above] = True
        mark[above + step] = True
        needs[d] = np.flatnonzero(mark[:n])
    far = np.concatenate([bucket, np.full(LENGTH, -1)])
    for d, step in ((8, 4), (16, 8), (25, 9), (50, 25), (100, 50)):
        places = needs[d]
        sizes = np.bincount(far[places][far[places] >= 0], minlength=1)
        active = places[sizes[far[places]] > 1]
        # Mates in a bucket are told apart by the bucket at the later offset; places alone keep their identifier.
        pairs = far[active] * np.int64(n + 2) + far[active + step] + 1
        _, fine = np.unique(pairs, return_inverse=True)
        fresh = far.copy()
        fresh[active] = fine + int(far.max()) + 1
        used, small_ids = np.unique(fresh[places], return_inverse=True)
        far = np.full(n + LENGTH, -1, np.int64)
        far[places] = small_ids
        depth = d
    assert depth == LENGTH
    return far[wanted]


def find_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: shown runs sorted by (anchor, doc, place) -> intervals of the strings that an earlier run of the anchor holds."""

    def settle(rows: list[tuple]) -> tuple[list[pa.RecordBatch], np.ndarray]:
        """The intervals, and which rows held a first occurrence."""
        data = b"".join(r[3] for r in rows)
        text = np.frombuffer(data, np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        starts = np.cumsum(sizes) - sizes
        strings = sizes - LENGTH + 1
        row = np.repeat(np.arange(len(rows)), strings)
        offset = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        classes = refine(text, starts[row] + offset)
        doc, place = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        tie, start, _ = unpacked(place)
        here = start[row] + offset
        order = np.lexsort((here, tie[row], doc[row], classes))
        again = np.concatenate([[False], classes[order][1:] == classes[order][:-1]])
        # The same string at the same place of the same document is one occurrence.
        first = np.maximum.accumulate(np.where(~again, np.arange(len(order)), 0))
        ids = np.column_stack([doc[row], tie[row], here])[order]
        repeated = again & (ids != ids[first]).any(1)
        hit = order[repeated]
        out = list(pieces(0, doc[row][hit], tie[row][hit], np.column_stack([here[hit], here[hit] + LENGTH]))) if len(hit) else []
        keeps = np.zeros(len(rows), bool)
        keeps[row[order[~again]]] = True
        return out, keeps

    rows: list[tuple] = []
    size, anchor, carried = 0, None, 0
    for batch in batches:
        for a, doc, place, data in zip(batch.column("anchor").to_pylist(), batch.column("doc").to_pylist(), batch.column("place").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if rows and a != anchor and size > BATCH:
                out, _ = settle(rows)
                yield from out
                rows, size = [], 0
            elif rows and a == anchor and size > 4 * BATCH + 2 * carried:
                out, keeps = settle(rows)
                yield from out
                rows = [r for r, k in zip(rows, keeps, strict=True) if k and r[0] == a]
                size = carried = sum(len(r[3]) for r in rows)
            if a != anchor:
                carried = 0
            anchor = a
            rows.append((a, doc, place, data))
            size += len(data)
    if rows:
        yield from settle(rows)[0]


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: documents with their intervals -> what is left of them."""
    for batch in batches:
        rows = []
        for doc_id, text, blobs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("blobs"), strict=True):
            data, start, stop = (text.as_py() or "").encode(), [], []
            if blobs.as_py():
                spans = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs.as_py()])
                start, stop = (x.tolist() for x in merged(spans[:, 0], spans[:, 1]))
            kept = b"".join(data[a:b] for a, b in zip([0, *stop], [*start, len(data)], strict=True))
            rows.append((doc_id, len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def with_ties(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (never null) and tie: 0, or the number among different texts of one id."""
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64("text").alias("_hash"))
    light = rows.select("doc", "_hash")
    several = light.groupBy("doc").agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi")).where("lo <> hi").select("doc")
    several = cut(several, "suffix-ids")
    if not several.limit(1).count():
        return rows.select("doc_id", "text", "doc", F.lit(0).alias("tie"))
    numbered = light.join(small(several, 500_000), "doc").distinct().withColumn("tie", F.row_number().over(Window.partitionBy("doc").orderBy("_hash")))
    numbered = cut(numbered, "suffix-ties")
    return rows.join(small(numbered, 500_000), ["doc", "_hash"], "left").select("doc_id", "text", "doc", F.coalesce("tie", F.lit(0)).alias("tie"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes) of every document."""
    texts = with_ties(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, math.ceil(total / BUCKET_BYTES))
    found = texts.select("doc", "tie", "text").mapInArrow(find_runs(buckets), PIECES)
    travels = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    dealt = found.withColumn("_to", travels).repartition(buckets, "_to").sortWithinPartitions("bucket").drop("_to")
    settled = cut(dealt.mapInArrow(settle_buckets, PIECES), "suffix-settled", compression="zstd")

    by_document = lambda df, what: df.groupBy("doc", "tie").agg(F.collect_list(what).alias("blobs"))
    asked = by_document(settled.where("bucket > 0"), F.struct("bucket", "blob"))
    asked = texts.select("doc", "tie", "text").join(asked, ["doc", "tie"]).select("doc", "text", "blobs")
    shown = asked.mapInArrow(show_bytes, "anchor long, doc long, place long, bytes binary")
    repeats = shown.repartition("anchor").sortWithinPartitions("anchor", "doc", "place").mapInArrow(find_repeats, PIECES)
    repeats = cut(repeats, "suffix-repeats", compression="zstd")
    spans = by_document(settled.where("bucket = 0").unionByName(repeats), "blob")
    joined = texts.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "blobs")
    return joined.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
