"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup, queries

from .conftest import BASE, DOCUMENTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, size):
    sets, nodes = [], []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
        nodes.append(doc_id)
    root = {d: d for d in nodes}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, n in counts.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n) and nodes[i] is not None and nodes[j] is not None:
                a, b = sorted((top(nodes[i]), top(nodes[j])))
                root[b] = a
    top_of = lambda d, s: top(d) if d is not None and s else d
    return sorted(((d, len(s), top_of(d, s), top_of(d, s) == d) for d, s in zip(nodes, sets, strict=True)), key=repr)


def near_copies(n=300):
    rng = random.Random(9)
    words = [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w), "en", "s"))
    return out


@pytest.mark.parametrize("kind", ["edge", "copies", "sample", "empty"])
def test_components(spark, tables, kind):
    folder = {"edge": lambda: tables(DOCUMENTS + DOCUMENTS[:3] + [(None, BASE, None, None), (4, BASE + " x", "en", "s")]), "copies": lambda: tables(near_copies()), "sample": lambda: "/root/testdata/sf0.001", "empty": lambda: tables([])}[kind]()
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op1_near_dedup(spark, folder).collect()), key=repr)
    want = plain(docs, 2)
    assert [x for x in got if x not in want] == [x for x in want if x not in got] and len(got) == len(want)


def family(n=400, sparse=60):
    """Copies of one text, edited apart: most are linked through it, others with each other only, many with nothing."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(90)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 16)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w), "en", "s"))
    for i in range(sparse):  # pairs of copies that share most of their edits
        w = list(base)
        for k in range(9):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((n + 2 * i, " ".join(w), "en", "s"))
        w[rng.randrange(len(w))] = rng.choice(words)
        out.append((n + 2 * i + 1, " ".join(w), "en", "s"))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_a_large_family_loses_no_link(spark, tables, monkeypatch, size):
    monkeypatch.setattr(near_dedup, "NEAREST", 1)
    monkeypatch.setattr(near_dedup, "STAR_ROWS", 16)
    folder = tables(family())
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain(docs, size)
    assert sorted((tuple(r) for r in near_dedup.label(frame, size).collect()), key=repr) == want
    frame = frame.withColumns({"_gone": F.lit(1), "node": F.lit("x"), "kept": F.lit(False)})
    kept = near_dedup.keep_one(frame, size)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, _, k in want if k)


def test_large_regions_in_parts(spark, tables, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_ROWS", 40)
    folder = tables(family(300, 30))
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted((tuple(r) for r in near_dedup.label(frame, 2).collect()), key=repr) == plain(docs, 2)


def places(rng, n, values):
    rows = np.array([[rng.randrange(3) + 1 for _ in range(n)], *([sum(rng.randrange(values) << 16 * k for k in range(4)) for _ in range(n)] for _ in range(2)), range(n)])
    return rows[:, np.lexsort(rows[::-1])]


@pytest.mark.parametrize("held", [40, 1 << 16])
def test_regions_adapt(monkeypatch, held):
    """Against plain Python: parts of at most CROWD members are complete, split regions name all members, however batches fall."""
    monkeypatch.setattr(near_dedup, "HELD_ROWS", held)
    rng = random.Random(held)
    rows = places(rng, 300, 3)
    rows = np.concatenate([rows, [[9, 10, 10, 10, 11], [0, 0, 1, 1, 0], [5, 5, 5, 6, 5], [900, 901, 902, 903, 904]]], axis=1)
    names = ["part", "deep", "deeper", "node", "of", "dealt"]
    whole = np.concatenate([rows, rows[:1], rows[:1] == 11])
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in whole[:, at : at + 23]], names=names) for at in range(0, rows.shape[1], 23)]
    got = [r for batch in near_dedup.neighbours(iter(batches)) for r in batch.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in got if r["region"] is None}
    members = sorted((r["region"], r["a"]) for r in got if r["region"] is not None)
    assert members == sorted((int(r), int(n)) for r, n in zip(rows[0], rows[3], strict=True) if r < 9 or r == 11)  # 11 is told to be dealt
    slots = {int(n): (int(r), *[int(x) >> 48 - 16 * k & 0xFFFF for x in (d, e) for k in range(4)]) for r, d, e, n in rows.T}
    want = set()
    for depth in range(1, 10):
        parts = {}
        for n, s in slots.items():
            parts.setdefault(s[:depth], []).append(n)
        for part in parts.values():
            if len(part) <= near_dedup.CROWD:
                want |= {(a, b) for a in part for b in part if a < b}
    ordered = [int(n) for n in rows[3]]
    beside = {(min(p), max(p)) for p in zip(ordered, ordered[1:], strict=False) if slots[p[0]][0] == slots[p[1]][0] < 9}
    assert pairs >= beside and (held < 1000 or pairs == want | beside)


def test_recall_of_links(spark):
    """Links of the sample table, with their classes joined by the query, against all pairs."""
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    got = {r["doc_id"]: r["component_id"] for r in queries.op1_near_dedup(spark, folder).collect()}
    want = {d: c for d, _, c, _ in plain(docs, 2)}
    assert got == want
