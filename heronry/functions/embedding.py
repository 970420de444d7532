"""Embedders as Arrow functions: one is made for each worker and gets batches of bounded bytes; a deterministic one that hashes words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Offset and prime of 32-bit FNV-1a (fixed values).
OFFSET, PRIME = 2_166_136_261, 16_777_619
WORD = re.compile(r"[^\W_]+")

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimensions: int) -> Embedder:
    """Bags of words: a word counts at the slot of its hash over UTF-16 units, so equal texts have equal vectors and shared words draw
    texts together. Texts without words have the zero vector."""

    @lru_cache(maxsize=100_000)
    def slot(word: str) -> int:
        h = OFFSET
        units = word.encode("utf-16-le")
        for k in range(0, len(units), 2):
            h = ((h ^ (units[k] | units[k + 1] << 8)) * PRIME) & 0xFFFFFFFF
        return h % dimensions

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in enumerate(texts):
            slots = [slot(w) for w in WORD.findall(text.lower())]
            out[row] = np.bincount(slots, minlength=dimensions) if slots else 0
        return out

    return embed


def _slices(texts: pa.Array, most: int) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters; a longer text is a run of its own; null counts as empty."""
    held, size = [], 0
    for text in texts.to_pylist():
        text = text or ""
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def embedded(text: Column, make: Callable[[], Embedder], dimensions: int, most: int = 1 << 20) -> Column:
    """The vector of each text. make() sets the embedder up, once for each task; it gets at most `most` characters at a time."""

    @F.arrow_udf(returnType=ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make()
        for batch in batches:
            parts = [embedder(texts) for texts in _slices(batch, most)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, dimensions), np.float32)
            if vectors.shape[1] != dimensions:
                raise ValueError(f"the embedder gave {vectors.shape[1]} dimensions, {dimensions} were asked for")
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * dimensions)
            yield pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), pa.float32()))

    return run(text)
