"""Archives and their index: a round trip against the pages themselves."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tessera.llm import queries, warc

PAGES = [
    (5, "http://b.example.com/x?q=1", "<p>same</p>"),
    (3, "http://a.example.com/", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (7, "http://A.example.com/y y", None),
    (8, "nonsense\r\nurl", ""),
    (1, "http://a.example.com/", "line\r\n\r\nWARC/1.1\r\n\r\nbreak\n\r"),
    (2, "http://a.example.com/", "é日本" * 5000),
    (2, "http://a.example.com/", "é日本" * 5000),
    (None, "http://c.example.org/", "<p>same</p>"),
    (11, "http://[bad/", "x\0y"),
]


@pytest.mark.parametrize("kind", ["edge", "sample", "empty"])
def test_round_trip(spark, tables, kind):
    folder = {"edge": lambda: tables(pages=PAGES), "sample": lambda: "/root/testdata/sf0.001", "empty": lambda: tables(pages=[])}[kind]()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()]
    first = {}
    for p, h in rows:
        if p is not None:
            first[h] = min(first.get(h, p), p)
    want = []
    for p, h in rows:
        to = first.get(h) if p is not None and first[h] != p else None
        want.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if to is not None else "response", to))
    got = queries.op8_warc(spark, folder).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=repr) == sorted(want, key=repr)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    index = warc.capture_index(warc.write_archives(pages), pages).collect()
    assert len(index) == len(got)
    ordered = sorted(index, key=lambda r: (r["span"], r["place"]))
    keys = [(r["url_key"], r["captured"], r["page_id"] or 0) for r in ordered]
    assert keys == sorted(keys)


def test_archives_are_plain_warc(spark, tables, tmp_path):
    folder = tables(pages=PAGES)
    path = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), str(tmp_path / "w"))
    found = [r for f in Path(path).glob("part*") for r in warc.parse(gzip.open(f))]
    assert len(found) == len(PAGES) and all(h["WARC-Record-ID"].startswith("<urn:uuid:") for h, *_ in found)
    for f in Path(path).glob("part*"):
        text = gzip.decompress(f.read_bytes())
        assert all(text[at : at + n].startswith(b"WARC/1.1\r\n") and text[at : at + n].endswith(b"\r\n\r\n") for _, _, at, n in warc.parse(gzip.open(f)))
    assert all(h["WARC-Profile"] == warc.PROFILE for h, *_ in found if h["WARC-Type"] == "revisit")


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
