"""Token counts without token ids: pieces are counted once per distinct pre-token and summed by frequency.

1. Blocks of documents become one row each: the block's distinct pre-tokens, and per document their frequencies as
   indexes into that list. Blocks hold up to `BLOCK_BYTES` of text (or one longer document).
2. The (block, pre-token) pairs are shuffled by pre-token and sorted; each run of equal pre-tokens is counted once.
3. The counts go back to their blocks, where each document's frequencies are weighted and summed.

The pre-token shuffle carries a word once per block, not once per use: that is its pre-aggregation, and a word that all
texts use costs one row per block. Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and
null ids are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.pretokens import SPLIT, load, pretokens, simple, tokenizer_path

BLOCK_BYTES = 24 << 20
#: A pair is one number: the block (partition and place in it), then the word's index in 28 bits.
AT_BITS = 28
BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, lengths binary, steps binary, times binary, words array<string>"


class Words(dict):
    """pre-token -> its index, in order of appearance."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found

    def of(self, text: str) -> np.ndarray:
        lower = text.lower()
        words = SPLIT.findall(lower) if simple(text, lower) else [x for chunk in text.encode().split() for x in pretokens(chunk)]
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, so that the empty upper planes of small numbers cost nothing."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: documents -> blocks. `steps` has each document's rising indexes as differences, `times` their frequencies, `lengths` how many there are."""
    from pyspark import TaskContext

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("lengths", pa.binary()), ("steps", pa.binary()), ("times", pa.binary()), ("words", pa.list_(pa.string()))])
    block = TaskContext.get().partitionId() << 16

    def rows() -> Iterator[tuple[int | None, str, int]]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                yield doc_id, text, len(text.encode())

    words, names, sizes, steps, times = Words(), [], [], [], []

    def made() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in steps])
        row = {"block": block, "doc_ids": names, "n_bytes": sizes, "lengths": squeezed(lengths), "steps": squeezed(np.concatenate(steps)), "times": squeezed(np.concatenate(times)), "words": list(words)}
        return pa.RecordBatch.from_pylist([row], schema)

    held = 0
    for doc_id, text, size in rows():
        if names and held + size > BLOCK_BYTES:
            yield made()
            words, names, sizes, steps, times, held, block = Words(), [], [], [], [], 0, block + 1
        which, count = np.unique(words.of(text), return_counts=True)
        names.append(doc_id)
        sizes.append(size)
        steps.append(np.diff(which, prepend=0).astype("<u4"))
        times.append(count.astype("<u4"))
        held += size
    if names:
        yield made()


def count_runs(vocabulary: str):
    """mapInArrow: (place, word) sorted by word -> (block, at, pieces); each run of one word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path(vocabulary))
        last, last_n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").dictionary_encode()
            distinct = words.dictionary.to_pylist()
            fresh = distinct[1:] if distinct[0] == last else distinct
            counts = ([last_n] if distinct[0] == last else []) + [len(x.ids) for x in tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            last, last_n = distinct[-1], counts[-1]
            pieces = np.array(counts, np.int32)[words.indices.to_numpy()]
            place = batch.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(place >> AT_BITS), pa.array((place & ((1 << AT_BITS) - 1)).astype(np.int32)), pa.array(pieces)], names=["block", "at", "pieces"])

    return run


def weigh(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """One block with the piece counts of its words -> its documents."""
    names, sizes, totals = [], [], []
    pieces = np.zeros(len(counts), np.int64)
    pieces[counts.column("at").to_numpy()] = counts.column("pieces").to_numpy()
    for row in blocks.to_pylist():
        lengths, steps, times = (unsqueezed(row[c]) for c in ("lengths", "steps", "times"))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        upto = np.concatenate([[0], np.cumsum(steps)])
        # A document's indexes are running sums of its own steps.
        which = upto[1:] - np.repeat(upto[ends[:-1]], lengths)
        weight = np.concatenate([[0], np.cumsum(pieces[which] * times)]) if len(which) else np.zeros(1, np.int64)
        totals.append(np.diff(weight[ends]))
        names += row["doc_ids"]
        sizes += row["n_bytes"]
    return pa.table({"doc_id": pa.array(names, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(np.concatenate(totals) if totals else [], pa.int64())})


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    blocks = cut(docs.select("doc_id", "text").mapInArrow(to_blocks, BLOCKS), "token-blocks", compression="zstd")
    pairs = blocks.select("block", F.posexplode("words").alias("at", "word")).select(F.shiftleft("block", AT_BITS).bitwiseOR(F.col("at")).alias("place"), "word")
    counts = pairs.repartition("word").sortWithinPartitions("word").mapInArrow(count_runs(vocabulary), "block long, at int, pieces int")
    return blocks.drop("words").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(weigh, "doc_id long, n_bytes long, n_tokens long")
