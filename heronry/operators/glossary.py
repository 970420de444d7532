"""Glossary checks of translations: terms of the original whose translation is missing, and words to avoid, by one automaton over whole texts.

All terms are found in one pass over a text, however many there are: an Aho-Corasick automaton over the text with runs of white space and
hyphens as one blank; what it finds counts between characters that are neither letters nor digits, with or without a plural or verb
ending. The glossary is an argument whose size is checked; each worker builds its automaton once a task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings that a term may have (fixed values), and terms that a glossary may have.
ENDINGS = ["", "s", "es", "ed", "ing"]
MOST_TERMS = 100_000
JOINTS = re.compile(r"[\s-]+")


@dataclass(frozen=True)
class Glossary:
    """terms: (term, its translation); avoid: (word, the word to use instead, terms of the original that make it apply; none: always)."""

    terms: tuple[tuple[str, str], ...]
    avoid: tuple[tuple[str, str, tuple[str, ...]], ...] = ()

    def __post_init__(self):
        if len(self.terms) + len(self.avoid) > MOST_TERMS:
            raise ValueError(f"a glossary of more than {MOST_TERMS} terms is no argument of a plan")


def _bare(text: str) -> str:
    return JOINTS.sub(" ", text.lower())


class Finder:
    """Which of some terms stand in a text."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in {_bare(t).strip() for t in terms} - {""}:
            self.automaton.add_word(term, term)
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def found(self, text: str) -> set[str]:
        if not self.some:
            return set()
        bare, out = _bare(text), set()
        for last, term in self.automaton.iter(bare):
            if term in out:
                continue
            first = last - len(term) + 1
            if (first == 0 or not bare[first - 1].isalnum()) and self._ends(bare, last + 1):
                out.add(term)
        return out

    @staticmethod
    def _ends(text: str, at: int) -> bool:
        return any(text.startswith(e, at) and (at + len(e) == len(text) or not text[at + len(e)].isalnum()) for e in ENDINGS)


def violations(pairs: DataFrame, key: str, original: str, translated: str, glossary: Glossary) -> DataFrame:
    """key, term, expected of every term that a translation breaks, each once for each pair; null texts count as empty."""

    def run(batches):
        finder = Finder([t for t, _ in glossary.terms] + [w for _, _, when in glossary.avoid for w in when])
        for batch in batches:
            keys, broken, expected = [], [], []
            for k, source, target in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held, target = finder.found(source or ""), target or ""
                low = target.lower()
                missing = [(t, e) for t, e in glossary.terms if _bare(t).strip() in held and e.lower() not in low]
                avoided = [(w, e) for w, e, when in glossary.avoid if w in target and (not when or any(_bare(x).strip() in held for x in when))]
                for term, instead in dict.fromkeys(missing + avoided):
                    keys.append(k)
                    broken.append(term)
                    expected.append(instead)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), pa.array(broken, pa.string()), pa.array(expected, pa.string())], names=["key", "term", "expected"])

    rows = pairs.select(F.col(key).alias("key"), F.col(original).cast("string").alias("a"), F.col(translated).cast("string").alias("b"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, term string, expected string")


def violation_counts(found: DataFrame) -> DataFrame:
    """term, expected, n of the pairs that break it."""
    return found.groupBy("term", "expected").agg(F.count("*").alias("n"))
