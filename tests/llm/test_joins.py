"""Regions, windows and recursion of the document join; recall of similar lines; padding; gaps; hot windows."""

from itertools import combinations

import numpy as np
import pytest

from heronry.llm import decontamination, jaccard_join, line_dedup, packing, warc_audit
from heronry.llm.common import span_hashes
from tests.llm.test_operators import fives, shingles


def families(rng, n, copies, words=60, changes=9):
    texts = []
    for f in range(n):
        base = [f"f{f}w{i}" for i in range(words)]
        for _ in range(copies):
            row = list(base)
            for at in rng.integers(0, words, rng.integers(0, changes)):
                row[at] = f"x{rng.integers(0, 1000)}"
            texts.append(" ".join(row))
    return texts


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in range(len(texts))}


def test_division_at_pivots_loses_no_pair(monkeypatch):
    rng = np.random.default_rng(2)
    texts = families(rng, 12, 25)
    sizes, owner, codes = next((s, o, c) for _, s, _, o, c in jaccard_join._sets(__import__("pyarrow").array(texts)))
    bits = np.stack([np.frombuffer(p, np.uint64) for p in jaccard_join._bitmaps(sizes, owner, codes)])
    n = len(texts)
    members = jaccard_join.Members(np.arange(n), np.arange(n), sizes, rng.random(n) < 0.8, bits)
    home, guests = np.flatnonzero(members.home), np.flatnonzero(~members.home)
    pairs = lambda found: {tuple(sorted(p)) for i, j, _ in found for p in zip(i.tolist(), j.tolist(), strict=True)}
    whole = pairs(members.compared(home, guests))
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    calls = []
    original = jaccard_join.Members.compared
    monkeypatch.setattr(jaccard_join.Members, "compared", lambda self, h, g: calls.append(len(h)) or original(self, h, g))
    assert pairs(members.joined(home, guests)) == whole and len(calls) > 10


def test_components_with_divided_regions_and_hot_shingles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = families(rng, 6, 30) + [f"one two three four five {k}" for k in range(40)] + [None, "", "one two three four five 7"]
    for name, value in (("LARGE", 16), ("PIVOTS", 4), ("GATHERED", 20), ("SMALL", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard_join.components(table).collect()} == brute(texts)


def test_pairs_at_exactly_three_quarters(spark):
    base = [f"w{i}" for i in range(18)]  # 14 shingles; sets of 14 and 14 with 12 common: 12/16
    at, over = base[:-2] + ["y", "z"], base[:-3] + ["x", "y", "z"]
    texts = [" ".join(base), " ".join(at), " ".join(over)]
    assert len(shingles(texts[0]) & shingles(texts[1])) * 4 == 3 * len(shingles(texts[0]) | shingles(texts[1]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.components(table).collect()} == brute(texts)


def test_word_hashes_differ_where_a_polynomial_would_not():
    word = lambda n, flip: bytes(97 + ((bin(i).count("1") + flip) & 1) for i in range(n))
    for n in (64, 1024, 4096):
        data = np.frombuffer(word(n, 0) + b" " + word(n, 1), np.uint8)
        a, b = span_hashes(data, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert a != b


def line(rng, words, size=6):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, size)) for _ in range(words))


def test_recall_of_similar_lines(spark):
    """Ordinary lines, lines without blanks and lines of another script, each with one similar line at a Jaccard similarity of 3/4 or more."""
    rng, texts = np.random.default_rng(6), []
    for k in range(400):
        kind = k % 4
        base = line(rng, 30) if kind == 0 else line(rng, 9) if kind == 1 else line(rng, 1, 60) if kind == 2 else "".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 60))
        other = list(base)
        for at in rng.integers(0, len(base), 3 if kind == 0 else 1):
            other[at] = "q" if other[at] != " " else " "
        texts += [base, "".join(other)]
    similar = [(a, a + 1) for a in range(0, len(texts), 2) if texts[a] != texts[a + 1] and 4 * len(fives(texts[a]) & fives(texts[a + 1])) >= 3 * len(fives(texts[a]) | fives(texts[a + 1]))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head = {r.doc_id: r.rep_doc_id for r in line_dedup.dedup_lines(table).collect()}
    assert len(similar) > 250 and sum(head[b] == a for a, b in similar) >= 0.95 * len(similar)
    assert all(head[i] in (i, i - i % 2) for i in head)


def test_recall_at_the_threshold(spark):
    """Lines of 120 to 1500 characters at a similarity of 0.75 to 0.80, with changed letters spread evenly: nine of ten at least meet, at each length."""
    rng, texts, lengths = np.random.default_rng(11), [], []
    for length in (120, 300, 500, 1000, 1500):
        made = 0
        while made < 150:
            base = line(rng, length // 6, int(rng.integers(3, 8)))[:length]
            changes = int(len(base) / rng.uniform(35, 46))
            other = list(base)
            for at in np.linspace(0, len(base) - 1, changes + 2)[1:-1].astype(int) + int(rng.integers(-3, 4)):
                other[at] = "q" if other[at] != "q" else "w"
            a, b = fives(base), fives("".join(other))
            if 0.75 <= len(a & b) / len(a | b) <= 0.80:
                texts += [base, "".join(other)]
                lengths.append(length)
                made += 1
    head = {r.doc_id: r.rep_doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for length in sorted(set(lengths)):
        pairs = [2 * k for k, n in enumerate(lengths) if n == length]
        assert sum(head[a + 1] == a for a in pairs) >= 0.9 * len(pairs), (length, sum(head[a + 1] == a for a in pairs), len(pairs))


def test_lines_without_doc_id(spark):
    """They are one document, which comes first: a similar line of another document goes, theirs stay at their number."""
    texts = [f"{'alpha beta gamma delta epsilon zeta eta theta'} number {i} of the rows\nshort" for i in range(40)]
    rows = line_dedup.dedup_lines(spark.createDataFrame([(None, t) for t in texts] + [(5, texts[0].replace("number 0", "number x"))], "doc_id long, text string")).collect()
    assert len(rows) == 82 and all(r.rep_doc_id is None and r.kept for r in rows if r.doc_id is None)
    assert [(r.rep_doc_id, r.rep_line_no, r.kept) for r in rows if r.doc_id == 5 and r.line_no == 0] == [(None, 0, False)]


@pytest.mark.parametrize("tokens", [1, 3, 5, 10, 40])
def test_short_documents_need_no_padding(tokens):
    pieces = [packing.Piece(i, 0, tokens, tokens, np.arange(tokens, dtype="<u4")) for i in range(8000)]
    sizes = [sum(p.length for p in s) for s in packing.pack_pieces(pieces, packing.Limits())]
    room = sum(n if n & (n - 1) == 0 else 4096 for n in sizes)
    assert sum(sizes) == 8000 * tokens and room <= 1.05 * sum(sizes)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_a_gap_is_one_row(spark, monkeypatch):
    rows = [(i, f"u{i}", f"text {i}") for i in range(256)] + [(None, f"n{i}", "x") for i in range(40)] + [(300, "same", f"v{i}") for i in range(60)]
    sound = warc_audit.records(pages(spark, rows))
    for lost in (3, 270, 330):
        got = warc_audit.located(sound, warc_audit.records(pages(spark, rows[:lost] + rows[lost + 1 :]))).collect()
        assert [(r.page_id, r.status) for r in got] == [(rows[lost][0], "missing")]
    monkeypatch.setattr(warc_audit, "PER_PART", 16)
    changed = [(p, u, f"{h}!") if i in (5, 260, 320) else (p, u, h) for i, (p, u, h) in enumerate(rows)] + [(300, "new", "page")]
    got = warc_audit.located(sound, warc_audit.records(pages(spark, changed))).collect()
    assert sorted((str(r.page_id), r.status) for r in got) == sorted([("5", "corrupt"), ("None", "corrupt"), ("300", "corrupt"), ("300", "surplus")])


def test_shared_and_repeated_windows():
    rng = np.random.default_rng(1)
    phrase = line(rng, 8)
    block = decontamination.Block([(i, f"{phrase} {line(rng, 20)}") for i in range(500)])
    copied = " ".join([phrase] * 300)
    assert list(block.leaks([copied.encode()], 0.5)) == []
    last = decontamination.Block([(7, f"{phrase} and then {line(rng, 20)}")])
    text = "some words before " + " ".join([phrase] * 20)
    assert list(last.leaks([text.encode()], 0.5)) == []


def test_leaks_equal_brute_force(spark):
    """Containment of literal windows along one alignment, for items and texts without slots."""
    rng = np.random.default_rng(9)
    vocabulary = [line(rng, 1) for _ in range(60)]
    words = lambda n: [vocabulary[i] for i in rng.integers(0, 60, n)]
    items = [words(14) for _ in range(30)]
    texts = []
    for k in range(120):
        item = items[k % 30]
        part = item[: int(rng.integers(5, 15))]
        texts.append(words(int(rng.integers(0, 20))) + part + words(int(rng.integers(0, 20))))
    want = set()
    for d, text in enumerate(texts):
        for b, item in enumerate(items):
            hits = [(i - j, j) for i in range(len(text) - 4) for j in range(len(item) - 4) if text[i : i + 5] == item[j : j + 5]]
            best = max((len({j for s, j in hits if low <= s <= low + decontamination.DRIFT}) for low, _ in hits), default=0)
            if hits and best >= 0.5 * (len(item) - 4):
                want.add((d, b))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(b, " ".join(t)) for b, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == want and len(want) > 40


def test_lost_and_added_copies_are_rows(spark):
    rows = [(i, f"u{i}", f"text {i}") for i in range(40)]
    sound = warc_audit.records(pages(spark, rows + rows[7:8] * 2 + rows[9:10]))
    audited = rows[:3] + rows[3:4] * 3 + rows[4:7] + rows[7:8] + rows[8:9] + [(9, "u9", "other")] + rows[9:]
    got = {(r.page_id, r.status, r.copies) for r in warc_audit.located(sound, warc_audit.records(pages(spark, audited))).collect()}
    assert got == {(3, "surplus", 2), (7, "missing", 2), (9, "corrupt", 1)}


def test_one_of_two_copies_lost_is_one_row(spark):
    rows = [(i, f"u{i}", "x") for i in range(40)] + [(5, "u5", "x")]
    got = warc_audit.located(warc_audit.records(pages(spark, rows)), warc_audit.records(pages(spark, rows[:-1]))).collect()
    assert [(r.page_id, r.status, r.copies, r.found_sha256) for r in got] == [(5, "missing", 1, None)]
