"""Page headers, embedders, glossaries, names and collations on odd texts."""

import re

import pytest
from pyspark.sql import functions as F

from heronry.functions import embedding, names
from heronry.functions import lexical as L
from heronry.functions import wording as W
from heronry.operators import glossary
from heronry.sources import headers


@pytest.mark.parametrize(
    ("html", "told"),
    [
        ("", ("no-list", [], "none", [])),
        ("<p>Authors: Ada Ito, Bo Li &amp; Cy</p><p>JIRA: <a href='x/K-12'>K-12</a></p>", ("listed", ["Ada Ito", "Bo Li", "Cy"], "one", ["K-12"])),
        ("<h1>Title</h1><p>Author: Late</p>", ("no-list", [], "none", [])),  # behind the first heading
        ("<h1>Title</h1><h2> Status </h2><p>Co-Author : Ada <b>It</b>o and Bo</p><h2>Motivation</h2><p>JIRA: K-3</p>", ("listed", ["Ada Ito", "Bo"], "none", [])),
        ("<table><tr><th>Authors:</th></tr></table>", ("unparsed", [], "none", [])),
        ("<p>Author: 12 Monkeys</p><p>Jira: K-1</p>", ("unparsed", [], "empty", [])),
        ("<p>Authors: <a class='user-mention x'>Ada, the First</a>, Bo</p>", ("unparsed", [], "none", [])),
        ("<p>Authors: <a class='user-mention'>Zoë O'Neil</a> (Bo) Li &lt;a@b.c&gt;</p><p>jira <span data-macro-name='jira'></span></p>", ("listed", ["Zoë O'Neil", "Bo", "Li"], "query", [])),
        ("<td>JIRA: K-5<br>K-5 K-6<p>Author: Ada", ("listed", ["Ada"], "several", ["K-5", "K-6"])),  # tags that never close
    ],
)
def test_headers(html, told):
    assert headers.read_header(html, "K") == told


def test_headers_of_null_and_very_long_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, "<p>Author: Ada</p>" + "<p>x</p>" * 50_000), (2, "<p>Author: Ada</p>")], "id long, page string")
    assert sorted((r.key, r.status) for r in headers.page_headers(pages, "id", "page", "K").collect()) == [(1, "no-list"), (2, "listed"), (2, "listed")]
    assert headers.page_headers(pages.limit(0), "id", "page", "K").count() == 0


def test_embedders_are_made_once_a_task_and_see_bounded_batches(spark):
    texts = [None, "", "One two one", "one TWO one", "x" * 500, "日本 é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)

    def make():
        inner, calls = embedding.hashing_embedder(8), []

        def embed(part):
            calls.append(sum(map(len, part)))
            assert len(part) == 1 or calls[-1] <= 20
            return inner(part)

        return embed

    got = {r.id: list(r.v) for r in rows.select("id", embedding.embedded(F.col("text"), make, 8, 20).alias("v")).collect()}
    assert got[0] == got[1] == [0.0] * 8 and got[2] == got[3] and sum(got[2]) == 3 and sum(got[4]) == 1 and sum(got[5]) == 2
    with pytest.raises(Exception, match="dimensions"):
        rows.select(embedding.embedded(F.col("text"), lambda: embedding.hashing_embedder(4), 8)).collect()


def test_glossary_against_a_pattern_for_each_term(spark):
    terms = (("Broker", "代理"), ("data  log", "日誌"), ("index", "索引"), ("ind", "x"), ("a.b", "y"))
    texts = ["Brokers and data-log", "brokered indexing", "abroker a.bs", "data\n log; INDEXES", "a.b", "reindex data logger", "", None, "indéx ind"]
    rows = [(i, t, z) for i, (t, z) in enumerate((t, z) for t in texts for z in ("", "代理 日誌 X", None))]
    avoid = (("软件", "軟體", ()), ("日誌", "紀錄", ("index",)))
    found = glossary.violations(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b", glossary.Glossary(terms, avoid))
    want = []
    for i, a, b in rows:
        has = lambda t: re.search(rf"(?i)(?<![^\W_]){'[\\s-]+'.join(map(re.escape, t.split()))}(?:s|es|ed|ing)?(?![^\W_])", a or "")  # noqa: E731, B023
        want += [(i, t, e) for t, e in terms if has(t) and e.lower() not in (b or "").lower()]
        want += [(i, w, e) for w, e, when in avoid if w in (b or "") and (not when or any(map(has, when)))]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_display_names(spark):
    family = "👨‍👩‍👧"
    rows = [("  Ada­  Ito‮ ", "Ada Ito"), ("ada", None), ("a@b", None), ("…!", None), (None, None), (family * 3 + "x", family * 3 + "x"), ("é" * 150, "é" * 100), ("x" + family * 150, "x" + family * 99), ("a\u0000bㅤc", "a b c"), ("x" * 99 + " y", "x" * 99)]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(rows)], "i int, n string")
    got = {r.i: r.d for r in df.select("i", names.display_name("n", F.lit("Ada")).alias("d")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]
    order = [r.n for r in spark.createDataFrame([(w,) for w in ["z", "é", "E", "e", "f", "Z"]], "n string").orderBy(names.collated("n")).collect()]
    assert order == ["e", "E", "é", "f", "z", "Z"]


def test_words_and_titles_from_their_rules(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y

    assert one(L.terms("x"), "a.bC() x-yZ KRaft $a.b_c 1.2") == ["a.bc()", "a", "bc", "x-yz", "x", "yz", "kraft", "$a.b_c", "$a", "b_c", "1", "2"]
    assert one(L.terms("x"), "HeartbeatRequest-ManagerV2 fetchDATA") == ["heartbeatrequest-managerv2", "heartbeatrequest", "managerv2", "heartbeat", "request", "manager", "v2", "fetchdata", "fetch", "data"]
    assert one(L.terms("x"), " ".join(f"aB{i}.c" for i in range(3000)))[-1] == "c"
    assert one(W.title_terms("x"), "v2Request max.pollMs -x- 3.9.1-rc #7 [2/3] a1B2c") == ["v2request", "max", "poll", "ms", "1-rc", "a1b2c"]
    assert one(W.member_key("x"), " [EXTERNAL]  re: RIF: [ext] Antw : Plan  B ") == "plan b"
    told = one(W.votes("x"), "+1\n -1, (non binding) no\n+1 binding!\n+1 but wait\n+10\n> -1\nFROM: x\n+1")
    assert [(v.vote, v.marker) for v in told.votes] == [("+1", None), ("-1", "non-binding"), ("+1", "binding")] and told.unclear == ["+1 but wait"] and told.ambiguous
    assert [one(W.person_led("x"), s) for s in ("It is late, said Ada.", "One two three four five said", "one two three four five six said", None)] == [True, True, False, False]
    assert [one(W.content_free("x"), s) for s in ("KAFKA-1 (#2) v3.4 is merged", "Broker gains codec", "", None)] == [True, False, True, True]
