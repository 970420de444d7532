"""Words, windows and shingles of many texts at once: numpy over the bytes of a slice of texts, no loop over words.

Texts are taken in slices of bounded size (a longer text is a slice of its own), so memory follows the slice or the longest text,
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from heronry.llm.common import BASE, MIX_A, mix64, span_hashes

#: Bytes between words: space and the control characters 9 to 13.
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Texts:
    """Words of some texts: `data` (bytes, a line end after each text), `starts`, `ends` and `owner` (number of the text) per word."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        word = np.concatenate([[False], ~GAP[self.data], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        stops = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(stops, self.starts, side="right")

    def hashes(self) -> np.ndarray:
        """One hash per word, A-Z folded to lower case."""
        return span_hashes(FOLD[self.data], self.starts, self.ends)


def slices(column: pa.Array, most: int = 1 << 20, rows: int = 10_000) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as UTF-8) for slices of at most `rows` texts and `most` bytes or one text; null counts as empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_buffer().to_pybytes() if value.is_valid else b""
        if held and (size + len(text) > most or len(held) == rows):
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words, by the run's first word; order counts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, factor = np.zeros(n, np.uint64), MIX_A
        for k in range(width):
            total += hashes[k : k + n] * factor
            factor = factor * BASE
        return mix64(total)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (owner, hash) pairs of all texts' shingles; a text of fewer words has its whole sequence as one shingle."""
    words = Texts(texts)
    hashes, owner = words.hashes(), words.owner
    codes = windows(hashes, width)
    inside = owner[: len(codes)] == owner[width - 1 :] if len(codes) else np.zeros(0, bool)
    codes, owners = codes[inside], owner[: len(inside)][inside]
    counts = np.bincount(owner, minlength=words.n)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = []
        with np.errstate(over="ignore"):
            for number, at in zip(short, first, strict=True):
                extra.append(windows(hashes[at : at + counts[number]], int(counts[number]))[0] + np.uint64(counts[number]))
        codes, owners = np.concatenate([codes, np.array(extra, np.uint64)]), np.concatenate([owners, short])
    order = np.lexsort((codes, owners))
    codes, owners = codes[order], owners[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])
    return owners[fresh], codes[fresh]
