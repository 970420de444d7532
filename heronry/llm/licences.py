"""License scans by a positional index of rare licence words, in DataFrame expressions alone.

Template words are ranked by their inverse document frequency over all documents; those far more frequent than their template's
rarer words are not looked up. Each text looks up the postings of all
other template words it holds, intersects them by relative position (text position minus template position, the same for all words of one
occurrence), and an occurrence counts when enough words agree and every mandatory key phrase stands at its place. The anchors of
key phrases are always looked up. The three base phrases are templates of which the phrase is all: each place is found.

A text's words and occurrences stay in its row; what is shuffled is one small row per looked-up word. Null text counts as empty
(0 words, no label, score 0); null doc_id stays null; repeated rows are reported each; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import id_and_text, table
from heronry.scratch import persisted

#: Base phrases and their labels (fixed values).
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Labels, passages of licences and notices, and the key phrases that must stand in them (fixed values).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("gpl", "licensed under the gnu general public license", ["gnu general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]

#: Words too common in any English text to look up (fixed values).
COMMON = set("a all and any are as at be by can for free in into is it made may not of or that the this to under use with without you your".split())

#: Runs of digits, ASCII letters and everything beyond ASCII; the same set as a negated class is some ten times slower to match.
WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Words that must agree at most; half of a template's words where it has fewer than twice as many.
AGREE = 8


def _templates() -> list[dict]:
    """Words, mask bits by position, and key phrases with their positions, of every template; base phrases come first."""
    out = []
    for label, text, phrases in [(label, phrase, [phrase]) for phrase, label in BASE] + TEMPLATES:
        words = text.split()
        places = {}
        for phrase in phrases:
            p = phrase.split()
            places[phrase] = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
        out.append({"label": label, "words": words, "marks": [i for i, w in enumerate(words) if w not in COMMON][:62], "phrases": places})
    return out


def _anchor(phrase: list[str], rank: dict[str, int]) -> int:
    return min((i for i, w in enumerate(phrase) if w in rank), key=lambda i: (rank[phrase[i]], i))


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text) and words; explode keeps the extraction from being repeated for each use of `words`."""
    # the Kelvin sign is the one character beyond ASCII whose lower case is an ASCII letter: only A-Z may be folded
    folded = F.lower(F.replace(F.col("text"), F.lit("K"), F.lit("")))
    return docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.array(F.regexp_extract_all(folded, F.lit(WORDS), F.lit(0)))).alias("words"))


def _strings(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")" if values else "cast(array() as array<string>)"


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many documents each template word stands, over all documents (at most as many rows as templates have words)."""
    vocabulary = sorted({t["words"][i] for t in _templates() for i in t["marks"]})
    found = _words(docs).select(F.explode(F.array_intersect(F.expr(_strings(vocabulary)), "words")).alias("word"))
    counted = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def telling_words(template: dict, df: dict[str, int], spread: int = 20) -> list[int]:
    """Positions of the words that are looked up: not those far more frequent than the template's rarer words are."""
    counts = sorted(df[template["words"][i]] for i in template["marks"])
    bound = spread * (counts[len(counts) // 4] + 5)
    return [i for i in template["marks"] if df[template["words"][i]] <= bound]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    docs, spark = id_and_text(docs), docs.sparkSession
    df, templates = document_frequencies(docs), _templates()
    for template in templates:
        template["marks"] = telling_words(template, df)
    rank = {w: i for i, w in enumerate(sorted(df, key=lambda w: (df[w], w)))}
    ranked = sorted({t["words"][i] for t in templates for i in t["marks"]}, key=rank.get)
    phrases = []  # (template, bit, phrase, anchor, position in the template)
    for t, template in enumerate(templates):
        for bit, (phrase, at) in enumerate(template["phrases"].items()):
            phrases.append((t, bit, phrase.split(), _anchor(phrase.split(), rank), at))
    anchors = sorted({p[2][p[3]] for p in phrases}, key=rank.get)
    known = "array(" + ", ".join(f"named_struct('id', {k}, 'anchor', '{p[2][p[3]]}', 'q', {p[3]}, 'words', {_strings(p[2])}, 'len', {len(p[2])})" for k, p in enumerate(phrases)) + ")"

    rows = _words(docs).withColumn("rare", F.expr(f"array_intersect({_strings(sorted({*ranked, *anchors}, key=rank.get))}, words)"))
    rows = rows.withColumn("positions", F.expr("CASE WHEN size(rare) = 0 THEN cast(array() AS array<int>) ELSE filter(sequence(0, size(words) - 1), i -> array_contains(rare, words[i])) END"))
    stands = "CASE WHEN x.anchor = words[p] AND p >= x.q THEN slice(words, p - x.q + 1, x.len) = x.words ELSE false END"
    rows = rows.withColumn("found", F.expr(f"CASE WHEN size(positions) = 0 THEN NULL ELSE transform(positions, p -> named_struct('p', p, 'w', words[p], 'ph', transform(filter({known}, x -> {stands}), x -> named_struct('id', x.id, 'at', p - x.q)))) END"))
    rows = persisted(rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "found"), "licence-words")

    one = rows.filter("found IS NOT NULL").select("doc_id", "key", F.explode("found").alias("o"))
    postings = [(w, t, bit, q) for t, x in enumerate(templates) for bit, (q, w) in enumerate((i, x["words"][i]) for i in x["marks"])]
    index = spark.createDataFrame(postings, "word string, template int, bit int, q int")
    words = one.join(F.broadcast(index), F.col("o.w") == F.col("word")).select("doc_id", "key", "template", (F.col("o.p") - F.col("q")).alias("shift"), F.expr("shiftleft(1L, bit)").alias("wm"), F.lit(0).cast("long").alias("pm"))
    places = spark.createDataFrame([(k, t, bit, at) for k, (t, bit, _, _, at) in enumerate(phrases)], "phrase int, template int, bit int, at int")
    keys = one.select("doc_id", "key", F.explode("o.ph").alias("x")).join(F.broadcast(places), F.col("x.id") == F.col("phrase")).select("doc_id", "key", "template", (F.col("x.at") - F.col("at")).alias("shift"), F.lit(0).cast("long").alias("wm"), F.expr("shiftleft(1L, bit)").alias("pm"))
    needs = spark.createDataFrame(
        [(t, x["label"], max(1, min(AGREE, -(-len({x["words"][i] for i in x["marks"]}) // 2))), len(x["marks"]), (1 << len(x["phrases"])) - 1) for t, x in enumerate(templates)],
        "template int, label string, least int, marks int, mandatory long",
    )
    occurrences = words.unionByName(keys).groupBy("doc_id", "key", "template", "shift").agg(F.bit_or("wm").alias("wm"), F.bit_or("pm").alias("pm"))
    agreed = occurrences.join(F.broadcast(needs), "template").filter("bit_count(wm) >= least AND pm = mandatory")
    labels = agreed.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("label").alias("method"), F.max(F.expr("bit_count(wm) / cast(marks AS double)")).alias("share"))

    base = F.expr(f"filter(coalesce(flatten(transform(found, o -> o.ph)), array()), x -> x.id < {len(BASE)})")
    base_names = F.expr(f"array_distinct(transform(places, x -> element_at({_strings([label for _, label in BASE])}, x.id + 1)))")
    rows = rows.withColumn("places", base).select("doc_id", "key", "n_words", F.size("places").cast("long").alias("n_base"), F.expr("cast(array_min(transform(places, x -> x.at)) AS long)").alias("first_word"), F.expr("cast(array_max(transform(places, x -> x.at)) AS long)").alias("last_word"), base_names.alias("named"))
    joined = rows.join(labels, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", F.sort_array("named")).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.array_union("named", F.coalesce("method", F.expr("cast(array() AS array<string>)"))))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"),
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
