"""Quality counts, token counts, token files, sharding and mixing against plain Python."""

import collections
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import queries, token_files
from tessera.llm.pretokens import load, tokenizer_path

from .conftest import DOCUMENTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(folder):
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module", params=["edge", "sample", "empty"])
def folder(request, tables):
    return {"edge": lambda: tables(DOCUMENTS + DOCUMENTS[:2] + [(None, "no id at all", None, None)]), "sample": lambda: SF, "empty": lambda: tables([])}[request.param]()


def counts(text):
    words = WORD.findall(text)
    seen = collections.defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark, folder):
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows(queries.op2_quality(spark, folder))), key=repr)
    want = []
    for doc_id, text in texts(folder):
        n, *rest = counts(text)
        want.append((doc_id, n, *rest, n < 10 or 100 * rest[-1] > 20 * n))
    assert got == sorted(want, key=repr)


def test_quality_verdict(spark, tables):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "river", "stone", "walking", "quiet", "morning", "a", "of", "garden", "letters", "blue", "under"]
    prose = [(i, " ".join(rng.choice(vocabulary, int(n))), "en", f"s{i % 2}") for i, n in enumerate(rng.integers(12, 120, 300))]
    prose = [p for p in prose if not 100 * counts(p[1])[4] > 20 * counts(p[1])[0]]
    junk = [(1000 + i, " | ".join(rng.choice(vocabulary, 80)), "en", f"s{i % 2}") for i in range(10)]
    kept = {r["doc_id"]: r["kept"] for r in rows(queries.op2_quality(spark, tables(prose + junk)))}
    assert all(kept[p[0]] for p in prose)
    assert not any(kept[j[0]] for j in junk)


def test_token_counts(spark, folder):
    tokenizer = load(tokenizer_path("word_bpe_49k.json"))
    want = [(d, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 2048) for d, t in texts(folder)]
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(queries.op3_token_counts(spark, folder))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_token_files(spark, folder):
    tokenizer = load(tokenizer_path("word_bpe_49k.json"))
    start, want = 0, []
    docs = texts(folder)
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(queries.op4_token_files(spark, folder))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for values in ([0], [0, 0, 0], [5], [0, 1 << 20], np.cumsum(rng.integers(0, 3000, 5000)), np.cumsum(rng.integers(0, 2, 5000)), np.sort(rng.integers(0, 1 << 40, 300))):
        ef = token_files.EliasFano.build(np.array(values))
        assert ef.select(np.arange(len(values))).tolist() == list(values)
    n = 100_000
    ef = token_files.EliasFano.build(np.cumsum(rng.integers(0, 2000, n)))
    assert ef.nbytes() * 8 < n * 13


def test_sharding(spark, folder):
    got = rows(queries.op7_sharding(spark, folder))
    docs = texts(folder)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((repr(d), len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = rows(queries.op7_sharding(spark, folder))
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixing(spark, folder):
    got = rows(queries.op9_mixing(spark, folder))
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    size = lambda r: len(WORD.findall(r["text"] or ""))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(r["doc_id"]), size(r)) for r in docs)
    if not docs:
        return
    whole = collections.Counter()
    for r in docs:
        whole[r["source"]] += size(r)
    names = sorted((s for s in whole if s is not None), key=lambda s: s.encode()) + [None] * (None in whole)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(whole.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * whole[s]}
        for s in over or open_:
            target[s] = 2.0 * whole[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    of = collections.defaultdict(list)
    for r in docs:
        of[(r["doc_id"], size(r))].append(r["source"])
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        s = next(x for x in of[(r["doc_id"], r["size"])] if abs(target[x] - r["target"]) < 1e-6 * max(1, target[x]) and whole[x] == r["source_size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6, s


def test_mix_documents_repeats_rows(spark, folder):
    from tessera.llm import mixing

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("times", mixing.F.lit("clash"))
    want = {(r["doc_id"], r["size"]): r["taken"] for r in rows(queries.op9_mixing(spark, folder))}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in rows(mixed):
        got[(r["doc_id"], len(WORD.findall(r["text"] or "")))] += len(WORD.findall(r["text"] or ""))
    for k, n in got.items():
        assert n >= want[k] and (want[k] or not k[1])


def crowded(spark, parts):
    """A third of the rows equal, a third of one id, some without an id."""
    rows_ = [(7, "same text")] * 1000 + [(8, f"other {i}") for i in range(1000)] + [(None, f"text {i % 50}") for i in range(500)] + [(100 + i, None) for i in range(500)]
    return spark.createDataFrame(rows_, "doc_id long, text string").repartition(parts)


def test_sharding_spreads_copies(spark):
    from tessera.llm import sharding

    one, two = (sorted((repr(tuple(r)) for r in sharding.shard_digests(crowded(spark, n)).collect())) for n in (3, 11))
    assert one == two and len(one) == 3000
    buckets = sharding.scatter(crowded(spark, 4), 16, 11).groupBy("bucket").count().collect()
    assert len(buckets) == 16 and max(r["count"] for r in buckets) < 300


def test_written_shards(spark, tmp_path):
    from tessera.llm import sharding

    frame = crowded(spark, 5).withColumns({"row": sharding.F.lit(1), "bucket": sharding.F.lit(2), "n": sharding.F.lit(3)})
    sharding.write_shards(frame, str(tmp_path / "shards"), shards=5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*frame.columns, "shard", "slot"} and back.count() == 3000
    sizes = {r["shard"]: (r["n_"], r["last"]) for r in back.groupBy("shard").agg(sharding.F.count("*").alias("n_"), sharding.F.max("slot").alias("last")).collect()}
    assert len(sizes) == 5 and all(n == 600 and last == 599 for n, last in sizes.values())


def test_sharding_moves_whole_documents(spark, folder, monkeypatch, tmp_path):
    """The query's places are those of files that hold the texts; equal rows and rows that differ in a null's column are told apart."""
    from tessera.llm import sharding

    monkeypatch.setattr(sharding, "new_path", lambda _, name: str(tmp_path / name))
    got = queries.op7_sharding(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    back = spark.read.schema(docs.withColumns({"slot": sharding.F.lit(1).cast("long"), "shard": sharding.F.lit(1)}).schema).parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, rows(back.select(*docs.columns)))) == sorted(map(repr, rows(docs)))
    assert sorted(map(repr, rows(back.select("doc_id", "shard", "slot")))) == sorted(map(repr, rows(got.select("doc_id", "shard", "slot"))))
    odd = spark.createDataFrame([(1, None, "a"), (1, "a", None)] * 30, "doc_id long, text string, lang string")
    assert sharding.scatter(odd, 16, 11).groupBy("row").count().count() == 2
    for most in (0, 100):  # few hashes occur twice, or more than may be broadcast
        monkeypatch.setattr(sharding, "REPEATS", most)
        spread = sharding.scatter(crowded(spark, 4), 16, 11)
        assert spread.count() == 3000 and max(r["count"] for r in spread.groupBy("bucket").count().collect()) < 300


def test_mixing_takes_rows_of_one_id_together(spark):
    from tessera.llm import mixing

    docs = crowded(spark, 4).withColumn("source", mixing.F.lit("one"))
    got = mixing.mix(docs).groupBy("doc_id", "size").agg(mixing.F.count_distinct("times").alias("n"), mixing.F.count("*").alias("rows")).collect()
    assert all(r["n"] == 1 for r in got) and sum(r["rows"] for r in got) == 3000


def test_other_vocabularies_are_refused():
    from tessera.llm import pretokens

    with pytest.raises(ValueError, match="splits texts otherwise"):
        pretokens.Encoder(tokenizer_path("byte_bpe_50k.json"))
