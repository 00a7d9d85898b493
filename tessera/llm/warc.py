"""WARC archives of pages, and a capture index merged from locally sorted runs.

Archives are gzipped WARC 1.1 text written by Spark (records end in two line ends, which is the writer's separator), so
the commit protocol covers them and any store can hold them. Of pages with equal payloads the smallest page_id becomes
a `response`, the others `revisit` records that name it and carry no payload.

Reading an archive back gives one run: its captures sorted by URL key (host reversed, then path) and time. The runs are
cut at common range bounds, and in each range a loser tree merges the pieces of all runs, which are already in order.
The bounds are over (URL key, time, page), so a URL that holds any share of the captures spreads over many ranges, and there
is a range for every RANGE_ROWS captures at most. Offsets and lengths in the index are those of an archive's text, since
Spark's writer makes one gzip member of each file. Archives are read in a stream; one record is held at a time.

Defined results: null html is an empty payload, and empty payloads are equal payloads; a null or odd url gets an empty
or cleaned URL key; rows without a page_id are responses; repeated rows of one page_id and payload are all what the id
is; an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, new_path, small

RECORDS_PER_FILE, RANGE_ROWS = 2000, 100_000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
# The digits of base 32, and the profile of revisits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUNS = "run string, pos long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
INDEX = RUNS + ", span int, place long"


def base32(sha1_hex: Column) -> Column:
    """The 40 hexadecimal digits of a SHA-1 as 32 digits of base 32: four from every five."""
    digits = []
    for g in range(8):
        value = F.conv(F.substring(sha1_hex, 5 * g + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(value, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*digits)


def record_id(page_id: Column) -> Column:
    h = F.md5(page_id.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))], F.lit(">"))


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), sha1 and refers_to (null for responses). Payloads are compared by digest and length."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    light = cut(rows.select("page_id", "sha1", F.octet_length("html").alias("size")), "warc-digests")
    firsts = light.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    firsts = cut(firsts.select("sha1", "size", "first"), "warc-firsts")
    later = light.join(small(firsts, 500_000), ["sha1", "size"]).where("page_id > first").select("page_id", "sha1", F.col("first").alias("refers_to")).distinct()
    later = cut(later, "warc-later")
    return rows.join(small(later, 500_000), ["page_id", "sha1"], "left")


def records(rows: DataFrame) -> DataFrame:
    """One column, value: the records without the two line ends that close them."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    size = F.octet_length("html").cast("string")
    head = F.concat(F.lit(HTTP), size, F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    moment = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("no page "), F.coalesce("url", F.lit("")), F.lit(" "), "sha1")))),
        line("WARC-Date", moment),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("X-Payload-Length", size),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    return rows.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Write pages(page_id, url, html) as archives; returns their folder."""
    path = path or new_path(pages.sparkSession, "warc")
    records(marked(pages)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, in lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def parse(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of every record in an archive's text, which is read as a stream."""
    at = 0
    while first := data.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"no record at {at}")
        head, headers = len(first), {}
        while (line := data.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the record at {at} has no end")
            head += len(line)
            name, value = line[:-2].decode().split(": ", 1)
            headers[name] = value
        size = int(headers["Content-Length"])
        block, end = data.read(size), data.read(4)
        if end != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        length = head + 2 + size + 4
        yield headers, block, at, length
        at += length


def read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (path, content) of archives -> their captures, each archive sorted as one run."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RUNS.split(", "), strict=True)])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            run = path.rsplit("/", 1)[-1]
            rows = []
            for headers, block, offset, length in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                size = int(headers["X-Payload-Length"])
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size, found = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest:
                        raise ValueError(f"the payload at {offset} of {run} has another digest than its record says")
                number = lambda h, headers=headers: int(headers[h]) if h in headers else None
                rows.append((url_key(headers.get("WARC-Target-URI", "")), headers["WARC-Date"], number("X-Page-Id"), size, digest, kind, number("X-Refers-To-Page"), offset, length))
            rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[7]))
            columns = [[run] * len(rows), list(range(len(rows))), *map(list, zip(*rows, strict=True))] if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class LoserTree:
    """Merges k sorted iterators: each inner node holds the loser of its match, so an item costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._less(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: a range's captures, run after run and each in order -> the captures in order. Holds one range."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    run, captured, key, page = (table.column(c).to_pylist() for c in ("run", "captured", "url_key", "page_id"))
    bounds = [0, *[i for i in range(1, len(run)) if run[i] != run[i - 1]], len(run)]

    def piece(a: int, b: int) -> Iterator[tuple]:
        return ((key[i], captured[i], page[i] is not None, page[i] or 0, i) for i in range(a, b))

    order = [x[-1] for x in LoserTree([piece(a, b) for a, b in zip(bounds, bounds[1:], strict=False)])]
    merged = table.take(pa.array(order, pa.int64()))
    merged = merged.append_column("span", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from merged.combine_chunks().to_batches(max_chunksize=10_000)


def capture_index(archives: str, pages: DataFrame) -> DataFrame:
    """All captures in the folder, in the order of (span, place): by URL key, then time."""
    spark = pages.sparkSession
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(archives).select("path", "content")
    runs = cut(files.mapInArrow(read_runs, RUNS), "warc-runs")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = max(least, -(-runs.count() // RANGE_ROWS))
    ranges = runs.repartitionByRange(spread, "url_key", "captured", "page_id").sortWithinPartitions("run", "pos")
    return ranges.mapInArrow(merge_runs, INDEX)
