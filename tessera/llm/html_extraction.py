"""Main text of pages by a recurrent block labeller: a bidirectional LSTM over the leaf blocks of each page.

Every block is a vector: hashed names and class words along its tag path, all its text's words in any script, hashed and
scaled to one length, and a few measures. The network reads a page's blocks in both directions, so a block is
judged in the light of the whole page. The weights (`html_model.npz`) come from `python -m tessera.llm.html_training`, on
made-up pages only.

Pages are labelled in groups of like length, each bounded in blocks, so memory doesn't grow with the input; a longer page
is read in stretches, forwards and then backwards, and only its hidden states are kept. Defined results: null, empty or textless pages give an empty text; ties and repeated rows each get
their result; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import io
import pkgutil
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.html_blocks import Block, Node, blocks

PATH_DIM, WORD_DIM, MEASURES = 128, 64, 12
INPUT = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 32
GROUP_BLOCKS, STRETCH = 16_384, 4096
GROUP_PAGES, GROUP_CHARS = 512, 1 << 23
MODEL = Path(__file__).with_name("html_model.npz")
_WORD = re.compile(r"[^\W\d_]+|[©®™|»›·]")


@lru_cache(maxsize=50_000)
def _label_vectors(label: str) -> tuple[np.ndarray, np.ndarray]:
    """What an element's name and class words add to the blocks directly in it, and to those farther below; hashed with a sign."""
    name, *words = label.split(".")
    both = np.zeros((2, PATH_DIM), np.float32)
    for v, depth in zip(both, "01", strict=True):
        for word in [f"<{name}>", *words]:
            for key in (word, depth + word):
                h = zlib.crc32(key.encode())
                v[h % PATH_DIM] += 1.0 if h >> 16 & 1 else -1.0
    return both[0], both[1]


def _path_vector(node: Node, far: dict[int, np.ndarray]) -> np.ndarray:
    """The element that holds a block, and all above it; far: what has been summed for elements so far."""
    if node.parent is None:
        return np.zeros(PATH_DIM, np.float32)
    todo, above = [], node.parent
    while above.parent is not None and id(above) not in far:
        todo.append(above)
        above = above.parent
    total = far.get(id(above), np.zeros(PATH_DIM, np.float32))
    for n in reversed(todo):
        total = far[id(n)] = total + _label_vectors(n.label)[1]
    return np.clip(total + _label_vectors(node.label)[0], -3, 3)


class WordPlaces(dict):
    """A word's place among 2 * WORD_DIM: the second half counts negatively."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = zlib.crc32(word.lower().encode())
        found = self[word] = h % WORD_DIM + (0 if h >> 16 & 1 else WORD_DIM)
        return found


_places = WordPlaces()


def features(page: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """A vector for every block of page[start:end]."""
    part, n = page[start:end], len(page)
    out = np.zeros((len(part), INPUT), np.float32)
    paths: dict[int, np.ndarray] = {}
    far: dict[int, np.ndarray] = {}
    for i, b in enumerate(part):
        row = out[i]
        if id(b.node) not in paths:
            paths[id(b.node)] = _path_vector(b.node, far)
        row[:PATH_DIM] = paths[id(b.node)]
        words = _WORD.findall(b.text)
        if words:
            hits = np.bincount([_places[w] for w in words], minlength=2 * WORD_DIM)
            counts = hits[:WORD_DIM] - hits[WORD_DIM:]
            row[PATH_DIM : PATH_DIM + WORD_DIM] = counts * (2 / np.sqrt(max(1, counts @ counts)))
        size = len(b.text)
        marks = min(1.0, 10 * sum(map(b.text.count, ".,;!?")) / size)
        ends = b.text[-1] in ".!?:\"'”’。！？"
        place = (start + i) / n - 0.5
        # Whether the blocks beside it are in the same element, or in one beside that.
        beside = [page[k].node if 0 <= k < n else None for k in (start + i - 1, start + i + 1)]
        alike = [x for other in beside for x in (other is b.node, other is not None and other.parent is b.node.parent)]
        row[PATH_DIM + WORD_DIM :] = (np.log1p(size) / 5 - 1, b.linked / size, marks, place, ends, np.log1p(b.node.depth) / 3, b.text[:1] == "©", 1.0, *alike)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Parameters of both directions (w: input, u: recurrent, b) and of the output (o, c)."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def load(cls) -> Labeller:
        # Through the loader, so that a package shipped as a zip works as well.
        with np.load(io.BytesIO(pkgutil.get_data(__package__, MODEL.name))) as stored:
            return cls({k: stored[k].astype(np.float32) for k in stored.files})

    def direction(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states of a batch x[page, block, feature], and the last one; the state stands still where the mask is 0."""
        p, hidden = self.p, HIDDEN
        h, c = state or (np.zeros((len(x), hidden), np.float32),) * 2
        out = np.zeros((*x.shape[:2], hidden), np.float32)
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        inputs = x @ p[f"w{d}"] + p[f"b{d}"]
        for t in steps:
            z = inputs[:, t] + h @ p[f"u{d}"]
            gates = sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            fresh = f * c + i * np.tanh(z[:, 3 * hidden :])
            m = mask[:, t, None]
            c = m * fresh + (1 - m) * c
            h = m * (o * np.tanh(fresh)) + (1 - m) * h
            out[:, t] = h
        return out, (h, c)

    def long_scores(self, page: list[Block], stretch: int = STRETCH) -> np.ndarray:
        """scores() of one page, a stretch of blocks at a time."""
        z = np.full(len(page), self.p["c"][0], np.float32)
        starts = range(0, len(page), stretch)
        for k, d in enumerate("fb"):
            state, weights = None, self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            for at in starts if d == "f" else reversed(starts):
                x = features(page, at, at + stretch)[None]
                hidden, state = self.direction(x, np.ones(x.shape[:2], np.float32), d, state)
                z[at : at + stretch] += hidden[0] @ weights
        return z

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of being main text, for every block of each page."""
        most = max(map(len, pages))
        x, mask = np.zeros((len(pages), most, INPUT), np.float32), np.zeros((len(pages), most), np.float32)
        for i, f in enumerate(pages):
            x[i, : len(f)], mask[i, : len(f)] = f, 1
        both = np.concatenate([self.direction(x, mask, d)[0] for d in "fb"], axis=2)
        z = both @ self.p["o"] + self.p["c"]
        return [z[i, : len(f)] for i, f in enumerate(pages)]


def groups(lengths: list[int]) -> Iterator[list[int]]:
    """Indexes of pages, like lengths together, a group's padded blocks bounded."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if held and (len(held) + 1) * lengths[i] > GROUP_BLOCKS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page: its blocks so labelled, in page order, one to a line."""
    out = [""] * len(pages)
    parsed = [blocks(p) for p in pages]
    full = [i for i, b in enumerate(parsed) if b]
    for group in groups([len(parsed[i]) for i in full]):
        mine = [full[i] for i in group]
        long = len(mine) == 1 and len(parsed[mine[0]]) > GROUP_BLOCKS
        found = [model.long_scores(parsed[mine[0]])] if long else model.scores([features(parsed[i]) for i in mine])
        for i, z in zip(mine, found, strict=True):
            out[i] = "\n".join(b.text for b, s in zip(parsed[i], z, strict=True) if s > 0)
    return out


def in_parts(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of at most so many pages and, if more than one, so many characters."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(pages), 0).to_pylist()):
        if i > start and (i - start >= GROUP_PAGES or held + size > GROUP_CHARS):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(pages):
        yield start, len(pages)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.load()
        for batch in batches:
            for start, end in in_parts(batch.column("html")):
                part = batch.slice(start, end - start)
                texts = main_texts(model, part.column("html").to_pylist())
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
