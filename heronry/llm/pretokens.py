"""Exact subword encoding through caches of whitespace-delimited pre-tokens.

The word tokenizer lower-cases, splits at white space and never merges across it, so the ids of a text are the ids of its
chunks put together. That holds for texts whose characters the fast path knows; every other text (letters outside Latin,
control characters, special strings) goes to the library as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


#: What the fast path leaves to the library: control and exotic space characters, soft hyphen, dotted capital I, everything
#: beyond Latin Extended-B, and the start of a special string (fixed values, as UTF-8 bytes).
ODD_BYTES = bytes([*range(9), *range(11, 32), 127, *range(0xCA, 256)])
ODD_PAIRS = re.compile(b"\xc2[\x80-\xa0\xad]|\xc4\xb0")

#: Letters, digits and marks as the tokenizer's splitting pattern has them, for the characters of the fast path (fixed values).
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+")


def is_plain(text: str) -> bool:
    """Whether the fast path knows all characters of the text."""
    data = text.encode()
    if len(data.translate(None, ODD_BYTES)) != len(data) or "<|" in text:
        return False
    return len(data) == len(text) or not ODD_PAIRS.search(data)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


LETTERS = byte_letters()


#: Characters of a chunk that is kept; together with the number of chunks it bounds a cache's bytes.
LONGEST = 40


class ChunkCache(dict):
    """chunk -> its ids as little-endian uint32 bytes; misses are encoded, and kept up to `cap` chunks of at most LONGEST characters beside the shared table."""

    def __init__(self, path: str, frequent: dict[str, bytes], cap: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.encoder, self.frequent, self.cap = Tokenizer.from_file(path), frequent, cap + len(frequent)
        self.model = self.encoder.model

    def _encode(self, text: str) -> bytes:
        return array("I", self.encoder.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.cap:
            self.clear()
            self.update(self.frequent)
        pieces = [chunk] if chunk.isalpha() else PIECE.findall(chunk)
        if len(pieces) > 1:
            ids = b"".join(map(self.__getitem__, pieces))
        else:
            letters = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(LETTERS)
            ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not is_plain(text):
            return self._encode(text)
        return b"".join(map(self.__getitem__, text.lower().split()))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


_CACHES: dict[tuple, ChunkCache] = {}


def worker_cache(path: str, frequent) -> ChunkCache:
    """The cache of this Python worker; it outlives tasks when Spark reuses the worker."""
    key = (path, frequent.id if hasattr(frequent, "id") else None)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = ChunkCache(path, frequent.value)
    return _CACHES[key]


def frequent_chunks(docs: DataFrame, path: str, sample_rows: int = 1000, sample_chars: int = 20_000, size: int = 30_000):
    """Broadcast table of frequent pre-tokens.

    It is filled from at most `sample_rows` rows of at most `sample_chars` characters and holds at most `size` entries of at
    most LONGEST characters, so its size has a fixed bound. It is a cache: what is missing from it is encoded where it occurs, so
    it never changes a result.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.length("text") <= sample_chars).select("text").limit(sample_rows).collect()
    counts: Counter[str] = Counter()
    for row in rows:
        if is_plain(row.text):
            counts.update(x for x in row.text.lower().split() if len(x) <= LONGEST)
    cache = ChunkCache(path, {})
    return spark.sparkContext.broadcast({chunk: cache[chunk] for chunk, _ in counts.most_common(size)})
