"""Repeated passages against a table of all 100-byte strings."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import queries, suffix_dedup

from .conftest import DOCUMENTS


def plain(docs):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            x = data[i : i + 100]
            if x in seen:
                gone[i : i + 100] = True
            seen.add(x)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((d, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(2)
    words = [rng.choice("bcdfgklmnprst") + rng.choice("aeiouéü") + rng.choice("bcdfgklmnprst") for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, line = prose(60), prose(12) + "\n"
    out = []
    for i in range(120):
        text = prose(rng.randrange(1, 150))
        if i % 3 == 0:
            at = rng.randrange(len(text))
            text = text[:at] + shared[rng.randrange(40) : len(shared) - rng.randrange(40)] + text[at:]
        if i % 7 == 0:
            text += line * rng.randrange(1, 6) + "ab" * rng.randrange(0, 120)
        if i % 10 == 9:
            text = out[i - 5][1][: -rng.randrange(1, 30)]
        out.append((i, text, "en", "s"))
    return out


def contexts():
    """One phrase of 70 bytes in hundreds of contexts, some of which come twice or reach farther on one side."""
    rng = random.Random(6)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(70))
    side = lambda n: "".join(rng.choice("klmnopqrst ") for _ in range(n))
    lefts, rights = [side(60) for _ in range(40)], [side(60) for _ in range(40)]
    out = []
    for i in range(700):
        left = rng.choice(lefts) if i % 3 else side(60)
        right = rng.choice(rights) if i % 4 else side(60)
        out.append((i, side(20) + left[rng.randrange(30) :] + phrase + right[: 60 - rng.randrange(30)] + side(20), "en", "s"))
    return out


@pytest.mark.parametrize("kind", ["edge", "passages", "contexts", "sample", "empty"])
def test_query(spark, tables, kind):
    edge = [r for r in DOCUMENTS if r[0] != 12] + [(12, "x" * 3000, None, None), (None, DOCUMENTS[0][1], None, None), (50, "é" * 49 + "y", None, None), (51, "é" * 49 + "y", None, None)]
    folder = {"edge": lambda: tables(edge), "passages": lambda: tables(passages()), "contexts": lambda: tables(contexts()), "sample": lambda: "/root/testdata/sf0.001", "empty": lambda: tables([])}[kind]()
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op6_suffix_dedup(spark, folder).collect()), key=repr)
    assert got == plain(docs)


def test_repeated_rows_and_small_batches(spark, tables, monkeypatch):
    base = passages()[:40]
    folder = tables(base + base[:3] + [(5, "other " * 40, "en", "s")])
    got = {}
    for r in queries.op6_suffix_dedup(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert len(set(got[0])) == 1 and len(got[0]) == 2 and len(got[5]) == 2


def test_refinement():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(97, 99, 400), np.tile(rng.integers(97, 120, 130), 4), np.full(250, 97)]).astype(np.uint8)
    places = np.arange(len(text) - 99)
    classes = suffix_dedup.refine(text, places)
    want = {}
    data = text.tobytes()
    labels = [want.setdefault(data[i : i + 100], len(want)) for i in places]
    assert len(set(classes.tolist())) == len(want)
    assert len(set(zip(classes.tolist(), labels, strict=True))) == len(want)


def test_a_frequent_anchor_in_batches(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    letters = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    middle, ends = letters(60), [letters(50) for _ in range(6)]
    rows = [(1, d, (50 << 12) | (50 << 6) | 20, rng.choice(ends)[:50] + middle + rng.choice(ends)[:10]) for d in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "doc", "place", "bytes"])

    def found():
        out = {}
        for b in suffix_dedup.find_repeats(iter([batch])):
            for d, blob in zip(b.column("doc").to_pylist(), b.column("blob").to_pylist(), strict=True):
                out.setdefault(d, []).extend(map(tuple, np.frombuffer(blob, np.int64).reshape(-1, 2).tolist()))
        return {d: sorted(set(v)) for d, v in out.items()}

    whole = found()
    monkeypatch.setattr(suffix_dedup, "BATCH", 1000)
    assert found() == whole


def test_hot_anchors_are_split():
    """The parts of a run hold each of its strings once, and equal strings have equal cores."""
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(40)) * 8
    anchor, lead, span = (np.array(x, np.int64) for x in ([60, 100, 140, 100], [50, 13, 30, 12], [50, 0, 18, 12]))
    place = suffix_dedup.packed(0, anchor, lead, span)
    cores, parts = suffix_dedup.by_cores(data, place)
    _, start, stop = suffix_dedup.unpacked(place)
    want = sorted(i for a, b in zip(start, stop, strict=True) for i in range(a, b - 99))
    _, start, stop = suffix_dedup.unpacked(parts)
    got = [(i, c, (parts[k] >> 12) & ((1 << 31) - 1)) for k, (a, b, c) in enumerate(zip(start, stop, cores, strict=True)) for i in range(a, b - 99)]
    assert sorted(i for i, _, _ in got) == want
    by = {}
    for i, c, a in got:
        by.setdefault((data[i : i + 100], int(a) - i), set()).add(int(c))
    assert all(len(c) == 1 for c in by.values())
