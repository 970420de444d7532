"""Corpus operators against brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from heronry.llm import decontamination, jaccard_join, licences, line_dedup, media, packing, quality, registry, token_counts, toxicity, warc_audit
from heronry.llm.pretokens import tokenizer_path
from tests.oracle import connect, difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key long, n long"
LINE = "a line of more than two dozen characters that several documents repeat"
TEXTS = [None, "", "one", "two words", LINE, f"{LINE}\n{LINE} indeed\nshort", "All rights reserved. CC BY 4.0; GNU General Public License", "é ß 日本語 it's 12% <|endoftext|> x", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 1 else None, t, None, "s", None, "clash", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[-2:], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_token_counts_equal_the_library(docs, odd, empty):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for table in (docs, odd):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(table, tokenizer_path()).collect()) == want
    assert token_counts.token_counts(empty, tokenizer_path()).count() == 0


def test_packing_places_every_id_once(odd, docs, empty):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    pieces = packing.pack_texts(docs, tokenizer_path()).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for key, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[key][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[key])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_texts(odd, tokenizer_path()).count() >= len(TEXTS)
    assert packing.pack_texts(empty, tokenizer_path()).count() == 0


def test_vector_limits_hold():
    rng = np.random.default_rng(3)
    sizes = [(int(n), int(rng.integers(0, n + 1))) for n in rng.integers(1, 90, 400)]
    pieces = [packing._Counted(i, 0, n, n, marked=m) for i, (n, m) in enumerate(sizes)]
    limits, seen = packing.Limits(100, 3, 60), set()
    with pytest.raises(ValueError):
        list(packing.pack_pieces([packing._Counted(0, 0, 101, 101, marked=1)], limits, cut=False))
    fitting = [p for p in pieces if p.marked <= 60]
    for sequence in packing.pack_pieces(fitting, limits, cut=False):
        assert sum(p.length for p in sequence) <= 100 and len(sequence) <= 3 and sum(p.marked for p in sequence) <= 60
        seen |= {p.key for p in sequence}
    assert seen == {p.key for p in fitting}


def test_media_round_trip_and_retries(spark, odd, empty, tmp_path):
    path = f"file://{tmp_path}/media"
    media.write_pictures(odd, path)
    rows = media.picture_features(media.read_members(spark, path, range_bytes=300)).collect()
    want = sorted(hashlib.sha256(media.pad64((r.text or "").encode())).hexdigest() for r in odd.collect())
    assert sorted(r.payload_sha256 for r in rows) == want and all(r.error is None for r in rows)
    media.write_pictures(empty, f"{path}-none")
    assert media.read_members(spark, f"{path}-none").count() == 0
    archive = next(p for p in (tmp_path / "media").iterdir() if p.suffix == ".zip" and p.stat().st_size > 400)
    data = bytearray(archive.read_bytes())
    data[data.index(media.PNG_MAGIC) + 20] ^= 255
    archive.write_bytes(data)
    broken = media.picture_features(media.read_members(spark, path)).filter("error is not null").collect()
    assert len(broken) == 1 and broken[0].payload_sha256 is None


def test_member_is_read_again_from_its_offset():
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("m", b"payload")

    class Flaky:
        fails = 2

        def get(self, at, size):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return held.getvalue()[at : at + size]

        def reset(self):
            pass

    info = zipfile.ZipFile(held).infolist()[0]
    assert media.read_member(Flaky(), info, 3) == (b"payload", None)
    assert media.read_member(Flaky(), info, 2)[0] is None


def brute_licences(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, names = [], set()
    for phrase, label in licences.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        names |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names))


def test_licence_base_equals_brute_force(docs, odd, empty):
    for table in (docs, odd):
        want = sorted(map(str, (brute_licences(r.text) for r in table.collect())))
        got = licences.scan(table).collect()
        assert sorted(str((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licences.scan(empty).count() == 0


def test_every_notice_of_a_text_is_found(spark):
    passages = [(label, text) for label, text, _ in licences.TEMPLATES]
    texts = [" . ".join(t for _, t in passages), " . ".join(t for _, t in passages if len(t.split()) > 12), "\n".join(t for label, t in passages if label in ("apache-2.0", "mit", "bsd"))]
    want = [{label for label, _ in passages}, {label for label, t in passages if len(t.split()) > 12}, {"apache-2.0", "mit", "bsd"}]
    got = {r.doc_id: set(r.labels.split(",")) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))


def test_quality_on_held_out_rows(spark, labels, odd, empty):
    big = "/root/testdata/sf0.01"
    big_docs, big_labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(big_docs, big_labels)
    rows = quality.quality_scores(big_docs, model).filter("held_out").join(big_labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert quality.quality_scores(odd, model).count() == odd.count()
    assert quality.accepted(odd, model).columns == odd.columns
    assert quality.train(odd, labels.limit(0)) is None and quality.quality_scores(empty, None).count() == 0


def test_toxicity(spark, odd, empty):
    big = "/root/testdata/sf0.1"
    big_docs, big_labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(big_docs, big_labels.filter("doc_id % 2 = 0"))
    rows = toxicity.severities(big_docs, model).join(big_labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95 and (np.diff(model.thresholds) > 0).all()
    assert toxicity.severities(odd, None).count() == odd.count() and toxicity.severities(empty, model).count() == 0


def shingles(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def test_components_equal_brute_force(spark, empty):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(120)) for _ in range(4)]
    texts = list(base) + TEXTS
    for k in range(60):
        words = base[k % 4].split()
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            words[at] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(table).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    assert {r.doc_id for r in jaccard_join.one_of_each(table).collect()} == {i for i in range(len(texts)) if find(i) == i}
    assert jaccard_join.components(empty).count() == 0


def test_similar_lines(spark, odd, empty):
    long = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil their broth near the old mill by the river"
    texts = [long, long.replace("quietly", "silently"), "another line that is long enough but is not like the others at all", f"{long}\nshort\nshort"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {(r.doc_id, r.line_no): r.kept for r in line_dedup.dedup_lines(table).collect()}
    assert kept == {(0, 0): True, (1, 0): False, (2, 0): True, (3, 0): False, (3, 1): True, (3, 2): True}
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(table).collect()} == {0: texts[0], 1: "", 2: texts[2], 3: "short\nshort"}
    out = line_dedup.without_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_one_of_each_decides_by_row(spark):
    words = lambda k: [f"{k}w{i}" for i in range(60)]
    text, near = (lambda k: " ".join(words(k))), (lambda k: " ".join(words(k)[:-1] + ["other"]))
    rows = [(2, text("a")), (None, near("a")), (None, text("b")), (None, near("b")), (None, text("c")), (5, near("a")), (5, text("d")), (7, text("e")), (7, text("f")), (None, None), (9, ""), (9, "")]
    got = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len([t for _, t in got if t in (text("b"), near("b"))]) == 1
    rest = [(2, text("a")), (None, text("c")), (5, text("d")), (7, text("e")), (7, text("f")), (None, None), (9, "")]
    assert sorted(map(str, (x for x in got if x[1] not in (text("b"), near("b"))))) == sorted(map(str, rest))


def fives(line):
    low = line.strip(" ").lower()
    return {low[i : i + 5] for i in range(len(low) - 4)}


def test_crowded_band_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    template, texts = " ".join(word() for _ in range(15)), []
    for _ in range(120):
        tail = [word() for _ in range(14)]
        texts.append(" ".join([template, *tail]))
        tail[int(rng.integers(0, 14))] = word()
        texts.append(" ".join([template, *tail]))
    sets, head = [fives(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 4 * common >= 3 * (len(sets[a]) + len(sets[b]) - common):
            head[b] = head[a]
    assert sum(h != i for i, h in enumerate(head)) == 120
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.rep_doc_id for r in line_dedup.dedup_lines(table).collect()} == dict(enumerate(head))


def test_short_equal_lines_go_in_query_and_pipeline(spark, tmp_path):
    texts = ["of, edti oner.\n\nab", "Of, edti oner. \n\nof, edti oners.", "ab"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.line_no) for r in rows if not r.kept} == {(1, 0), (2, 0)} and len(rows) == 7
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()} == {0: texts[0], 1: "\nof, edti oners.", 2: ""}


def test_similar_lines_meet_in_a_band_of_any_size(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    template = [word() for _ in range(24)]
    texts = [" ".join(template + [word() for _ in range(7)]) for _ in range(3000)]
    for text in texts[:40]:  # three words of the tail change, so that the copy shares bands of the template alone
        texts.append(" ".join(word() if at in (24, 27, 30) else w for at, w in enumerate(text.split())))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.rep_doc_id for r in line_dedup.dedup_lines(table).collect()}
    assert got == {i: i - 3000 if i >= 3000 else i for i in range(3040)}


def test_lines_that_differ_at_an_end(spark):
    texts = ["1. terms of use of this whole site page 12", "2. terms of use of this whole site page 13", "see the full index on p. 31", "see the full index on p. 32", "contact our editorial team1", "contact our editorial team2"]
    for x, y in zip(texts[::2], texts[1::2], strict=True):
        assert 4 * len(fives(x) & fives(y)) >= 3 * len(fives(x) | fives(y))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.rep_doc_id for r in line_dedup.dedup_lines(table).collect()} == {i: i - i % 2 for i in range(6)}


def test_leaks_and_templates(spark, docs, sf_dir, odd, empty):
    item = "A train leaves Paris at 9 and travels 120 km in 2 hours before it reaches the second station on the line"
    other = "A train leaves Rome at 7 and travels 300 miles in 5 hours before it reaches the second station on the line"
    clean = "Nothing in this passage resembles the question about railway travel between two large cities of Europe"
    table = spark.createDataFrame([(1, f"Some words before. {item} and after"), (2, other), (3, clean)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.leaks(table, bench).collect()}
    assert found.keys() == {1, 2} and found[1].changed_slots == 0 and found[2].changed_slots > 0
    assert [r.doc_id for r in decontamination.without_leaks(table, bench).collect()] == [3]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {(r.doc_id, b.item_id) for b in items.collect() for r in docs.collect() if " ".join(b.text.lower().split()) in " ".join((r.text or "").lower().split())}
    assert whole <= {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert decontamination.leaks(odd, bench).count() == 0 and decontamination.leaks(empty, bench.limit(0)).count() == 0


def test_fixity_audit(spark, sf_dir):
    assert difference(warc_audit.op10_warc_audit(spark, sf_dir), connect(sf_dir), warc_audit.OP10_SQL) is None
    odd = spark.createDataFrame([(None, None, None, 1), (5, "u", "", 1), (5, "u", "", 1), (6, None, "x", 1)], "page_id long, url string, html string, offset long")
    assert warc_audit.located(warc_audit.records(odd), warc_audit.records(odd)).count() == 0
    lost = warc_audit.located(warc_audit.records(odd), warc_audit.records(odd.filter("page_id = 5"))).collect()
    assert {r.page_id for r in lost} == {None, 6} and {r.status for r in lost} == {"missing"}


def test_pipeline_stages_keep_columns(spark, sf_dir, docs):
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, sf_dir)
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in current.select("doc_id").collect()}
        current = after
    assert corpus_pipeline.STAGES[-1][1](spark, current, sf_dir).count() > 0


def test_registry_names():
    assert [n.split("_")[0] for n in registry.QUERIES][:10] == [f"op{i}" for i in range(1, 11)]
