"""Edit matching against a plain dynamic programme."""

import random

from tessera.llm import decontamination as d
from tessera.llm import queries


def plain(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def spoil(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("abcdexyz") + text[at:], text[:at] + rng.choice("abcdexyz") + text[at + 1 :]])
    return text


def test_myers_and_pieces():
    rng = random.Random(3)
    words = ["the", "of", "and", "river", "stone", "walk", "green", "tower"]
    for _ in range(60):
        item = d.normal(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))))
        text = d.normal(" ".join(rng.choice(words) for _ in range(40)) + " " + spoil(rng, item, rng.randrange(0, 8)) + " " + " ".join(rng.choice(words) for _ in range(20)))
        p = d.Pattern(item)
        assert p.nearest(text)[0] == plain(item, text)
        assert bool(d.Matcher([(1, item)]).hits(text)) == (plain(item, text) <= p.errors)


def test_query(spark, tables):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) + rng.choice("abc") for _ in range(30))) for i in range(5)] + [(5, None), (6, ""), (7, "--"), (None, "short one")]
    other = " ".join(rng.choice("north south east west up down left right".split()) for _ in range(200))
    docs = [
        (0, other, "en", "s"),
        (1, f"{other} {items[0][1].upper()}, {other}", "en", "s"),
        (2, other + "\n" + spoil(rng, items[1][1], 5), "en", "s"),
        (3, None, None, None),
        (4, "", "en", "s"),
        (5, items[2][1][:60], "en", "s"),
        (6, "a Short  one.", "en", "s"),
        (6, "a Short  one.", "en", "s"),
        (None, items[3][1] + "!", "en", "s"),
        (8, "shortone", "en", "s"),
    ]
    folder = tables(docs, benchmark=items)
    got = sorted((repr(r["doc_id"]), r["item_id"]) for r in queries.op5_decontamination(spark, folder).collect())
    assert got == sorted([("1", 0), ("2", 1), ("6", None), ("6", None), ("None", 3)], key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    kept = d.drop_contaminated(read("documents"), read("benchmark"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 8]
    assert kept.columns == read("documents").columns
    empty = tables([])
    assert queries.op5_decontamination(spark, empty).collect() == []
