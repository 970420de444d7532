"""JSON and small documents as columns: canonical form, extraction from model text, paths, references, tallies, bounded renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions.text import text


def canonical(c) -> Column:
    """JSON with sorted keys and without spaces; null where it can't be read."""
    return F.to_json(F.try_parse_json(text(c)))


def canonical_digest(c) -> Column:
    return F.sha2(canonical(c).cast("binary"), 256)


def model_json(c) -> Column:
    """The JSON object or array that a model's answer holds, also inside a code fence or between sentences; null where there is none."""
    found = F.regexp_extract(text(c), r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", canonical(found))


def at_path(c, path: str) -> Column:
    """The value at a path like a.b[0] as text; null where a key is missing."""
    return F.get_json_object(canonical(c), f"$.{path}")


def classification(c, topics: list[str]) -> Column:
    """struct(topic, confidence, routine) of a model's row; a topic out of the list is 'other' at 0, an unreadable row all defaults."""
    row = F.from_json(model_json(c), "topic string, confidence double, routine boolean")
    known = F.coalesce(row["topic"].isin(topics), F.lit(False))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(row["confidence"], F.lit(0.0))))
    return F.struct(F.when(known, row["topic"]).otherwise("other").alias("topic"), F.when(known, confidence).otherwise(0.0).alias("confidence"), F.coalesce(row["routine"], F.lit(False)).alias("routine"))


def likeliest(probabilities: Column, labels: list[str], canary: str, most: float = 0.5) -> Column:
    """The label of the largest probability; null where the canary label, which no input has, is given more than `most`."""
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1
    return F.when(F.get(probabilities, labels.index(canary)) <= most, F.get(F.array(*map(F.lit, labels)), best))


def tally_text(plus: Column, binding: Column, quorum: int, minus: Column, complete: Column) -> Column:
    """A vote count as one line; a count that isn't complete says 'at least'."""
    least = F.when(complete, "").otherwise("≥ ")
    head = F.concat(F.when(complete, "").otherwise("seen "), F.lit("+1 × "), plus, F.lit(" · binding "), least, binding, F.lit(f" of {quorum}"))
    return F.concat(head, F.when(minus > 0, F.concat(F.lit(" · binding -1 × "), least, minus)).otherwise(""))


def first_rule(c, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The topic of the first rule (topic, pattern) that matches."""
    out = F.lit(default)
    for topic, pattern in reversed(rules):
        out = F.when(text(c).rlike(pattern), topic).otherwise(out)
    return out


def rejection(sentence, cites: Column, most: int = 240, stance: tuple[str, ...] = ("should", "must", "hopefully")) -> Column:
    """Why a sentence may not be shown: length (in code points), no citation, or a word of stance; null where nothing speaks against it."""
    words = F.split(F.lower(text(sentence)), r"[^a-z]+")
    return F.when((F.length(text(sentence)) > most) | (F.length(F.trim(text(sentence))) == 0), "length").when(F.size(cites) == 0, "uncited").when(F.arrays_overlap(words, F.array(*map(F.lit, stance))), "stance")


def completion_form(c, forms: list[str], modals: list[str]) -> Column:
    """The first completion form that no modal precedes in its clause; null where there is none."""
    form = rf"(?i)\b({'|'.join(forms)})\b"
    clauses = F.transform(F.split(text(c), r"[,;:，；：]"), lambda x: F.struct(F.regexp_extract(x, form, 1).alias("f"), F.regexp_extract(x, rf"(?is)^(.*?)\b(?:{'|'.join(forms)})\b", 1).alias("before")))
    kept = F.filter(clauses, lambda x: (x["f"] != "") & ~x["before"].rlike(rf"(?i)\b(?:{'|'.join(modals)})\b"))
    return F.lower(F.get(kept, 0)["f"])


def rendered(title: Column, excerpts: Column, most: int, size: int) -> Column:
    """A thread as text: its title and at most `most` excerpts, each clipped to `size` characters."""
    lines = F.transform(F.slice(excerpts, 1, most), lambda e: F.concat(F.lit("- "), F.when(F.length(e) > size, F.concat(F.substring(e, 1, size - 1), F.lit("…"))).otherwise(e)))
    more = F.when(F.size(excerpts) > most, F.array(F.concat(F.lit("… "), F.size(excerpts) - most, F.lit(" more")))).otherwise(F.expr("cast(array() AS array<string>)"))
    return F.array_join(F.concat(F.array(title), lines, more), "\n")
