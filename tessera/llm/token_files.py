"""Token ids in files: one concatenated id array per file, document boundaries in Elias-Fano code.

A boundary list of n + 1 rising offsets up to u is kept in n * (2 + log2(u / n)) bits: the low bits packed, the high
bits in unary, and one 32-bit count for each 512 bits of the unary part, by which `select` finds an offset.

Files are rows of a Parquet table in the shared folder (`part`, `seq`, counts, document ids, and `blob`, the file's
bytes), so Spark's commit protocol covers them, any store can hold them, and a lost executor costs one task. A file ends
at `FILE_IDS` ids; only a single longer document exceeds that.

Defined results: null and empty texts hold the end id alone; documents come in order of (doc_id, hash of the text), null
ids first, repeated rows beside each other; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut
from tessera.llm.pretokens import encoder, tokenizer_path

MAGIC = b"EFTOK001"
HEAD = struct.Struct("<8sQQBBQQQ")  # magic, documents, ids, low bits, bytes of an id, bytes of low, high and counts
FILE_IDS = 2 << 20
BLOCK = 512
FILES = "part int, seq int, n_docs long, n_ids long, doc_ids array<long>, blob binary"


class EliasFano:
    """Rising integers values[0..n], with select(i) = values[i]."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(-(-(int(places[-1]) + 1 if n else 0) // BLOCK) * BLOCK, np.uint8)
        unary[places] = 1
        counts = np.concatenate([[0], np.cumsum(unary.reshape(-1, BLOCK).sum(1, dtype=np.int64))[:-1]]) if len(unary) else np.zeros(0)
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), counts.astype(np.uint32))

    def select(self, which) -> np.ndarray:
        """values[which], block by block: the counts find the block of a one, the block's bits its place."""
        which = np.asarray(which, np.int64)
        block = np.searchsorted(self.counts, which, side="right") - 1
        out = np.empty(len(which), np.int64)
        for b in np.unique(block):
            mine = block == b
            ones = np.flatnonzero(np.unpackbits(self.high[b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little"))
            out[mine] = ones[which[mine] - int(self.counts[b])] + b * BLOCK
        high = out - which
        if not self.low_bits:
            return high
        at = which[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.counts.nbytes


def to_blob(ids: bytes, width: int, bounds: np.ndarray) -> bytes:
    """A file: ids of width bytes, bounds the starts of the documents and the end of the last."""
    ef = EliasFano.build(bounds)
    return HEAD.pack(MAGIC, len(bounds) - 1, len(ids) // width, ef.low_bits, width, ef.low.nbytes, ef.high.nbytes, ef.counts.nbytes) + ef.low.tobytes() + ef.high.tobytes() + ef.counts.tobytes() + ids


def from_blob(blob: bytes) -> tuple[EliasFano, np.ndarray]:
    """The boundaries and the ids, without copying them."""
    magic, docs, ids, low_bits, width, *sizes = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at, parts = HEAD.size, []
    for size, kind in zip(sizes, (np.uint8, np.uint8, np.uint32), strict=True):
        parts.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return EliasFano(docs + 1, low_bits, *parts), np.frombuffer(blob, f"<u{width}", ids, at)


def encode_files(vocabulary: str, end_id: int):
    """mapInArrow: documents in order -> files."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path(vocabulary))
        end, part, seq = np.array([end_id], encode.kind).tobytes(), TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def file() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]) // encode.width
            row = {"part": part, "seq": seq, "n_docs": len(texts), "n_ids": int(bounds[-1]), "doc_ids": names, "blob": to_blob(b"".join(texts), encode.width, bounds)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                got = encode.encode(text.as_py()) + end
                if texts and held + len(got) > FILE_IDS * encode.width:
                    yield file()
                    texts, names, held, seq = [], [], 0, seq + 1
                texts.append(got)
                names.append(doc_id)
                held += len(got)
        if texts:
            yield file()

    return run


def write_files(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Encode docs(doc_id, text) in ascending order of doc_id into files; returns the table of files."""
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return cut(ordered.drop("_tie").mapInArrow(encode_files(vocabulary, end_id), FILES), "token-files", compression="zstd")


def read_documents(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: files -> their documents' places, lengths and checksums, by way of select."""
    for batch in files:
        for row in batch.to_pylist():
            bounds, ids = from_blob(row["blob"])
            at = bounds.select(np.arange(row["n_docs"] + 1))
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = row["n_docs"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"],
            )


def document_index(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_first"))
    firsts = sizes.join(parts, "part").select("part", "seq", (F.col("part_first") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("first"))
    rows = files.mapInArrow(read_documents, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    return rows.join(firsts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
