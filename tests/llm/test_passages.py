"""Fill-in-the-middle and substring deduplication against their SQL twins, brute force and odd tables."""

import hashlib
import random
import re

import pytest

from heronry.llm import infilling, registry, substrings
from tests.oracle import connect, difference

SCHEMA = "doc_id long, text string, lang string, n long, form string, chunk long, docs string, places string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "clash", 1, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_substring_dedup"])
def test_query_matches_its_sql(spark, sf_dir, name):
    assert difference(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL[name]) is None


ODD = [(None, None), (1, ""), (2, "a\n\x01b\x02a\x02b\n\n\nlast\x01"), (3, "x<P>y\nz"), (4, "\n" * 5), (5, "é日本\r\nx" * 4000), (2, "a\n\x01b\x02a\x02b\n\n\nlast\x01"), (6, "<\n<S\n<\nM>\n"), (7, "no line end"), (None, "$1\\1\n$0\n")]


@pytest.mark.parametrize("seed", range(4))
def test_any_text_comes_back(spark, seed):
    rows = infilling.infilled(frame(spark, ODD), seed=seed).withColumn("back", infilling.restored(infilling.F.col("output"), infilling.F.col("form"))).collect()
    assert sorted(r.text for r in rows) == sorted(t or "" for _, t in ODD)
    for r in rows:
        assert r.back == r.text
        assert r.n == len(re.findall(r"[^\n]*\n|[^\n]+", r.text))
        if r.form == "plain":
            assert r.output == r.text and r.prefix is None and (not r.text or re.search("<[PSM]>", r.text))
        else:
            units = re.findall(r"[^\n]*\n|[^\n]+", r.text)
            draw = [int(hashlib.sha256(f"{seed}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
            a, b = sorted(d % (r.n + 1) for d in draw[:2])
            assert [r.prefix, r.middle, r.suffix] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
            assert r.form == ("spm" if draw[3] % 100 < 50 else "psm")


def test_rates_and_units(spark):
    docs = frame(spark, [(i, "one two three\nfour five\n") for i in range(200)])
    assert {r.form for r in infilling.infilled(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in infilling.infilled(docs, spm_rate=100).collect()} == {"spm"}
    assert {r.n for r in infilling.infilled(docs, unit=r"\S+\s*").collect()} == {5}
    assert infilling.infilled(docs.limit(0)).count() == 0


def kept_by_force(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for k, ws in enumerate(words):
        for i in range(len(ws) - substrings.WINDOW + 1):
            seen.setdefault(tuple(ws[i : i + substrings.WINDOW]), []).append((k, i))
    gone = {(k, j) for places in seen.values() if len(places) > 1 for k, i in places for j in range(i, i + substrings.WINDOW)}
    return [(len(ws), sum((k, j) in gone for j in range(len(ws))), " ".join(w for j, w in enumerate(ws) if (k, j) not in gone)) for k, ws in enumerate(words)]


def passages(seed):
    """Texts that share passages of 30 to 60 words at all phases, with periodic texts, near misses, repeats and odd white space."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé日") for _ in range(rng.randint(1, 5)))
    some = [[word() for _ in range(rng.randint(30, 60))] for _ in range(8)]
    texts = [None, "", " \x0b\x1c ", "a " * 34, "a " * 35, "a " * 36, "a b " * 40, " ".join(some[0]), " ".join(some[0])]
    for _ in range(60):
        text = [word() for _ in range(rng.randint(0, 40))]
        for p in rng.sample(some, rng.randint(0, 3)):
            a, b = sorted(rng.randint(0, len(p)) for _ in range(2)) if rng.random() < 0.5 else (0, len(p))
            text += p[a:b] + [word() for _ in range(rng.randint(0, 20))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in text))
    return texts


@pytest.mark.parametrize("held", [40, 1_000_000])
def test_repeated_passages_go_as_by_force(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD", held)
    monkeypatch.setattr(substrings, "CHUNK", 600)
    texts = passages(held)
    rows = substrings.without_repeats(frame(spark, [(i if i % 7 else None, t) for i, t in enumerate(texts)])).collect()
    want = sorted((t or "", *x) for t, x in zip(texts, kept_by_force(texts), strict=True))
    assert sorted((r.text, r.n_words, r.n_removed, r.kept) for r in rows) == want
    assert substrings.without_repeats(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_the_cover_aligns_any_two_positions():
    assert all(any((i + d) % substrings.PERIOD in substrings.COVER and (j + d) % substrings.PERIOD in substrings.COVER for d in range(substrings.PERIOD)) for i in range(substrings.PERIOD) for j in range(substrings.PERIOD))


def test_a_long_passage_in_many_documents(spark):
    passage = " ".join(f"w{i}" for i in range(20_000))
    rows = substrings.without_repeats(frame(spark, [(i, f"head{i} {passage} tail{i}") for i in range(12)])).collect()
    assert {(r.n_removed, r.kept) for r in rows} == {(20_000, f"head{i} tail{i}") for i in range(12)}
