"""Rules held against case tables: edge cases of each function and the results to be had.

The cases were written from the rules' descriptions; arrays are joined by '|', structs are JSON, null is '~'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions import calendar as C
from heronry.functions import lexical as L
from heronry.functions import text as T
from heronry.functions import wording as W
from heronry.functions import documents as D
from heronry.operators import monitoring as M
from heronry.operators import records as R


CASES: list[tuple] = []


def cases(name: str, schema: str, value: Callable[[], Column], table: list[tuple]) -> None:
    """table: rows of (inputs..., result)."""
    CASES.append((name, schema, value, table))


col = F.col


# --- words and terms -----------------------------------------------------------------------------------------------------------

cases("str_01_terms", "x string", lambda: L.terms(L.nfkc("x"), False), [
    ("Producer.send() fails", "producer.send()|producer|send|fails"), ("rack-aware fetch", "rack-aware|rack|aware|fetch"), ("KafkaRaft", "kafkaraft"), ("ﬁle Ａ１", "file|a1"), ("", ""), (None, ""),
])
cases("str_02_code_terms", "x string", lambda: L.terms("x"), [
    ("HeartbeatRequestManager", "heartbeatrequestmanager|heartbeat|request|manager"), ("HTTPServer", "httpserver|http|server"), ("max.pollRecords", "max.pollrecords|max|pollrecords|poll|records"), ("KAFKA-12", "kafka-12|kafka|12"), ("plain words", "plain|words"),
])
cases("str_03_case_words", "x string", lambda: L.case_words(col("x")), [
    ("KRaft", "KRaft"), ("IDs", "IDs"), ("HTTPServer", "HTTP|Server"), ("fetchV2Request", "fetch|V2|Request"), ("aBcD", "aBcD"), ("aBCd", "aB|Cd"), ("a", "a"), ("word", "word"), ("planB", "planB"),
])
cases("str_04_reading_words", "x string", lambda: L.reading_words("x"), [
    ("The HeartbeatRequestManager, again", "the|heartbeat|request|manager|again"), ("a.b.pollRecords() x-y", "a|b|poll|records|x|y"), (" ", ""),
])
cases("str_05_adjacent", "x string, y string", lambda: F.array_contains(L.word_pairs(L.reading_words("x")), col("y")), [
    ("read the request manager now", "request manager", "true"), ("manager of request", "request manager", "false"), ("RequestManager", "request manager", "true"), ("one", "one two", "false"),
])
cases("str_06_exact_query", "x string", lambda: L.is_exact_query("x"), [("KAFKA-1", "true"), (" 1234 ", "true"), ("a.b()", "true"), ("kafka 1", "false"), ("two words", "false"), ("", "false")])
cases("str_07_query_terms", "x string", lambda: L.query_terms("x"), [("poll poll RequestManager", "poll|requestmanager|request|manager"), ("KIP-1 kip-1", "kip-1|kip|1")])
cases("str_08_excerpt", "x string, y array<string>", lambda: L.matched_excerpt("x", col("y"), 12), [
    ("abcdefghijklmnop rare word", ["rare"], "…nop rare wor…"), ("short", ["none"], "short"), ("rare at the start of it", ["start", "rare"], "rare at the…"), ("", ["a"], ""),
])
cases("str_09_passage", "x string", lambda: L.matched_excerpt("x", F.expr("cast(array() AS array<string>)"), 10), [("0123456789abc", "0123456789…"), ("0123456789", "0123456789"), (None, "")])
cases("str_10_identifiers", "x string", lambda: L.canonical_identifiers("x", ["KIP", "KAFKA"]), [("see kip 12 and KAFKA7", "see KIP-12 and KAFKA-7"), ("skip 3", "skip 3"), ("kip-5x kip-6", "kip-5x KIP-6")])
cases("str_11_keys", "x string", lambda: F.concat(T.numbered_proposals("x"), T.issue_keys("x")), [("KIP 9, KAFKA-3 and kafka-3, KIP-9", "KIP-9|KAFKA-3|KIP-9"), ("none", "")])
cases("str_12_subject_key", "x string", lambda: T.thread_key("x"), [("Re: FW:  Vote   on it", "vote on it"), ("Regarding: x", "regarding: x"), (None, "")])
cases("str_13_member_key", "x string", lambda: W.member_key("x"), [("[EXTERNAL] Re: AW: Plan  B", "plan b"), ("re: [Caution] sv: x", "x"), ("Ready: x", "ready: x"), ("Rif: x", "x"), ("RV: x", "rv: x"), ("vs:antw: x", "x")])
cases("str_14_mail_author", "x string", lambda: T.mail_author("x"), [('"Ada Ito" <a@b.c>', "Ada Ito"), ("Ada Ito via dev <d@e.f>", "Ada Ito"), ("Ada", "Ada")])
cases("str_15_name_key", "x string", lambda: T.name_key("x"), [('  "Ada"  ITO ', "ada ito"), ("O'Neil", "oneil")])
cases("str_16_votes", "x string", lambda: W.votes("x"), [
    ("+1 (binding)\nThanks", '{"votes":[{"vote":"+1","marker":"binding","line":"+1 (binding)"}],"unclear":[],"ambiguous":false}'),
    (" -1 because of it", '{"votes":[{"vote":"-1","line":"-1 because of it"}],"unclear":[],"ambiguous":false}'),
    ("+1 to what was said\n> +1", '{"votes":[],"unclear":["+1 to what was said"],"ambiguous":false}'),
    ("hello\n--- Original Message ---\n+1", '{"votes":[],"unclear":[],"ambiguous":true}'),
    ("+1\nFrom: Ada\nhello", '{"votes":[{"vote":"+1","line":"+1"}],"unclear":[],"ambiguous":false}'),
    ("+1 (non-binding), lgtm\n+10 more", '{"votes":[{"vote":"+1","marker":"non-binding","line":"+1 (non-binding), lgtm"}],"unclear":[],"ambiguous":false}'),
])
cases("str_18_markdown", "x string", lambda: T.markdown_plain("x", 20), [("# Title\n\n`code` [link](http://u) ![i](u)", "Title code link"), ("```\nx\n``` rest", "rest"), ("0123456789 0123456789 0123", "0123456789 01234567…")])
cases("str_19_jira", "x string", lambda: T.jira_plain("x"), [("h2. Head\n{code:java}x{code} see [text|http://u]", "Head see text"), ("*bold*", "bold")])
cases("str_21_status", "x string", lambda: W.status_of("x"), [("Released in 3.1", "Adopted"), ("early  access", "Early Access"), ("Moved to KIP-2", "Discarded"), ("Under Discussion", "Under Discussion"), ("Accepted, voting over", "Adopted"), ("", "Unknown"), (None, "Unknown")])
cases("str_23_title_terms", "x string", lambda: W.title_terms("x"), [("KIP-12: Add RequestManager to 4.4.0 [1/N]", "request|manager|4.4.0"), ("MINOR: fix the build.gradle #12 fix", "fix|build|gradle"), ("", "")])
cases("str_25_subject_tag", "x string", lambda: W.has_tag("x", "VOTE"), [("Re: [vote] it", "true"), ("vote it", "false")])
cases("str_28_protected", "x string", lambda: F.array(W.protected("x", ["Raft", "KRaft"]), W.restored(W.protected("x", ["Raft", "KRaft"]), ["Raft", "KRaft"])), [("KRaft and Raft", "⟦1⟧ and ⟦0⟧|KRaft and Raft"), ("none", "none|none")])
cases("str_30_style", "x string", lambda: F.array(W.person_led("x").cast("string"), W.content_free("x").cast("string")), [
    ("Ada asked for a review of it", "true|false"), ("The broker restarts faster, said Ada.", "true|false"), ("KIP-12 is merged", "false|true"), ("Compression gains a third codec", "false|false"),
])
cases("str_31_discussed", "x string", lambda: W.discussed_proposal("x"), [("[DISCUSS] KIP-7: it", "KIP-7"), ("Discuss: KIP 8", "KIP-8"), ("[DISCUSS] KIP-7 and KIP-8", "~"), ("[VOTE] KIP-7", "~")])
cases("str_32_reviewers", "x string", lambda: W.reviewers("x"), [("Fix\n\nReviewers: Ada Ito <a@b.c>, Bo  Li", "Ada Ito|Bo Li"), ("Reviewer: x@y.z, Cy", "Cy"), ("none", "")])
cases("str_33_person_key", "x string", lambda: W.person_key("x"), [(" @Ada-1 ", "ada-1"), ("two words", "~"), ("-x", "~"), (None, "~")])
cases("str_34_person_id", "x string, y string", lambda: W.person_id(col("x"), col("y")), [("github", " Ada ", "github:ada"), ("mail", '"Ada"  Ito', "mail:ada ito"), ("mail", "unknown sender", "~"), ("jira", "Ghost", "~")])
cases("str_35_redacted", "x string", lambda: T.redact("x", ["s3cr3t"]), [("a s3cr3t here", "a [redacted] here"), ("token=abcdefghij0123456789", "token=[redacted]"), ("plain", "plain")])
cases("str_37_proposal_title", "x string", lambda: W.proposal_title("x"), [("[DISCUSS] KIP-5: New codec", "New codec"), ("KIP-6 - Old", "Old"), ("No id", "No id")])
cases("str_38_semantic_query", "x string", lambda: W.collapsed(L.nfkc("x")), [("  ﬁnd   KRaft ", "find KRaft"), ("Ａ", "A")])
cases("str_39_wiki_status", "x string", lambda: W.wiki_status("x"), [("<p>Current state: <b>Accepted</b></p>", "Accepted"), ("Current state: Under Discussion.", "Under Discussion"), ("nothing", "~")])
cases("fil_06_machine", "x string", lambda: T.is_machine(col("x"), ["ci-runner"]), [("dependabot[bot]", "true"), ("CI-Runner", "true"), ("robot", "false")])
cases("fil_08_notification", "x string", lambda: T.is_notification_subject("x"), [("[jira] [Created] x", "true"), ("Re: [PR] y", "true"), ("about [jira]", "false")])
cases("mat_08_token_estimate", "x string", lambda: T.estimate_tokens("x"), [("abcd", 1), ("KAFKA-123", 5), ("漢字", 2), ("", 0)])
cases("arr_01_weighted", "x string, y string, z array<string>", lambda: L.weighted_terms("x", "y", col("z"), F.lit("ada")), [("New codec", "a body", ["core"], "new|codec|new|codec|new|codec|new|codec|a|body|core|core|ada"), ("", "", [], "ada")])
cases("arr_02_unique_sorted", "x array<string>", lambda: F.array_sort(F.array_distinct("x")), [(["b", "a", "b"], "a|b"), ([], "")])
cases("arr_03_superset", "x array<string>", lambda: F.size(F.array_except(F.array(F.lit("a"), F.lit("b")), "x")) == 0, [(["b", "c", "a"], "true"), (["a"], "false"), ([], "false")])
cases("arr_04_areas", "x array<string>, y array<string>", lambda: W.areas(col("x"), col("y"), ["stale"]), [(["core", "kip-12", "stale", "build"], ["KIP-3"], '{"labels":["build","core"],"ids":["KIP-3","KIP-12"]}'), ([], [], '{"labels":[],"ids":[]}')])

# --- calendar and numbers --------------------------------------------------------------------------------------------------------

ts = lambda c: F.to_timestamp(col(c))
cases("dat_01_instant", "x string", lambda: C.instant(col("x")), [("2026-09-29T20:24:00.702+0000", "2026-09-29T20:24:00.702Z"), ("2026-09-29T20:24:00+02:00", "2026-09-29T18:24:00.000Z"), ("nonsense", "~"), (None, "~")])
cases("dat_02_days_before", "x string", lambda: C.days_before(ts("x"), 7), [("2024-03-03 01:00:00", "2024-02-25T01:00:00.000Z")])
cases("dat_04_months", "x string, y string", lambda: C.months_back(ts("x"), ts("y")), [("2024-03-15", "2024-01-20", "2024-01|2024-02|2024-03"), ("2024-03-15", "2020-01-01", "2023-04|2023-05|2023-06|2023-07|2023-08|2023-09|2023-10|2023-11|2023-12|2024-01|2024-02|2024-03"), ("2024-03-15", "2024-05-01", "")])
cases("dat_06_bucket_ends", "x string", lambda: F.array(C.iso(C.bucket_start(col("x"))), C.iso(C.bucket_end(col("x")))), [("2024-02", "2024-02-01T00:00:00.000Z|2024-02-29T23:59:59.999Z"), ("2024-01-29", "2024-01-29T00:00:00.000Z|2024-02-04T23:59:59.999Z")])
cases("dat_07_coverage", "x string, y string, z string", lambda: C.clipped_coverage(ts("x"), ts("y"), ts("z")), [("2024-01-01", "2024-02-01", "2023-12-01", "2024-02-01T00:00:00.000Z"), ("2024-01-01", None, "2024-03-01", "2024-03-01T00:00:00.000Z")])
cases("dat_08_month_plus", "x string, y int", lambda: C.month_plus(col("x"), col("y")), [("2024-01", -1, "2023-12"), ("2023-11", 14, "2025-01"), ("2024-06", 0, "2024-06")])
cases("dat_09_elapsed", "x string", lambda: F.array(F.round(C.elapsed_share(ts("x"), "month"), 6), F.round(C.elapsed_share(ts("x"), "day"), 6)).cast("array<string>"), [("2024-02-15 12:00:00", "0.5|0.5"), ("2024-03-01 00:00:00", "0.0|0.0"), ("2024-04-16 00:00:00", "0.5|0.0")])
cases("dat_10_age", "x string, y string", lambda: F.array(C.whole_days(ts("x"), ts("y")).cast("string"), C.age_state((F.unix_millis(ts("y")) - F.unix_millis(ts("x"))), 86_400_000, 172_800_000)), [("2024-01-01", "2024-01-02 23:59:59", "1|warning"), ("2024-01-01", "2024-01-03", "2|firing"), ("2024-01-01", "2024-01-01 01:00:00", "0|ok")])
cases("dat_12_release_time", "x string", lambda: C.release_time(col("x")), [("feed-20240131T120000Z-ab12", "2024-01-31T12:00:00.000Z"), ("feed-1", "~")])
cases("dat_13_backfill_start", "x string", lambda: C.backfill_start(col("x"), F.lit("2024-06-01").cast("timestamp")), [("2024-05-31", "2024-05-31"), ("2024-06-02", "~"), ("2023-05-01", "~"), ("2024-02-30", "~"), ("x", "~")])
cases("mat_09_cost_units", "x long, y long", lambda: C.cost_units(col("x"), col("y"), 1075.0, 4000.0), [(1000, 0, 1), (2_000_000, 500_000, 4150), (0, 0, 0)])
cases("mat_10_projected", "x double, y double", lambda: C.projected(col("x"), col("y")), [(10.0, 0.25, 40.0), (7.0, 0.0, 7.0)])
cases("mat_11_floored", "x double, y int", lambda: F.when(col("y") == 2, C.floored(col("x"), 2)).otherwise(C.floored(col("x"), 4)), [(0.29, 2, 0.29), (1.239, 2, 1.23), (0.12349, 4, 0.1234)])
cases("mat_12_rounded", "x double", lambda: C.rounded4(col("x")), [(0.12345, 0.1235), (0.70834, 0.7083), (1.0, 1.0)])
cases("mat_13_axis_step", "x double", lambda: C.nice_step(col("x")), [(7.0, 5.0), (30.0, 10.0), (31.0, 20.0), (100.0, 50.0), (0.0, 1.0)])
cases("mat_14_backoff_hours", "x int", lambda: C.backoff_hours(col("x")), [(0, 24), (1, 48), (4, 384), (5, 720), (9, 720)])
cases("jsn_01_canonical", "x string", lambda: D.canonical("x"), [('{"b": 1, "a": {"d": [2, 1], "c": null}}', '{"a":{"c":null,"d":[2,1]},"b":1}'), ("[3, 1]", "[3,1]"), ("{broken", "~"), ("", "~")])
cases("jsn_03_model_json", "x string", lambda: D.model_json("x"), [('Sure:\n```json\n{"topic": "a"}\n```', '{"topic":"a"}'), ("[1, 2] done", "[1,2]"), ("no json", "~"), ("{half", "~")])
cases("jsn_04_classification", "x string", lambda: D.classification("x", ["core", "docs"]), [
    ('{"topic":"core","confidence":0.8,"routine":true}', '{"topic":"core","confidence":0.8,"routine":true}'), ('{"topic":"new","confidence":1}', '{"topic":"other","confidence":0.0,"routine":false}'), ("?", '{"topic":"other","confidence":0.0,"routine":false}'), ('{"topic":"docs","confidence":7}', '{"topic":"docs","confidence":1.0,"routine":false}'),
])
cases("jsn_05_likeliest", "x array<double>", lambda: D.likeliest(col("x"), ["a", "b", "canary"], "canary"), [([0.2, 0.7, 0.1], "b"), ([0.1, 0.2, 0.7], "~"), ([0.4, 0.2, 0.4], "a")])
cases("jsn_06_path", "x string", lambda: D.at_path("x", "a.b[1]"), [('{"a":{"b":[1,"two"]}}', "two"), ('{"a":{}}', "~"), ("no", "~")])
cases("jsn_08_bytes", "x string, y int", lambda: F.hex(F.to_json(F.struct("x", "y")).cast("binary")), [("é", 1, "7B2278223A22C3A9222C2279223A317D")])
cases("str_17_tally", "x int, y int, z boolean", lambda: D.tally_text(col("x"), col("y"), 3, F.lit(0), col("z")), [(4, 3, True, "+1 × 4 · binding 3 of 3"), (2, 1, False, "seen +1 × 2 · binding ≥ 1 of 3")])
cases("str_24_first_rule", "x string", lambda: D.first_rule("x", [("build", r"(?i)\b(?:gradle|build)\b"), ("client", r"(?i)\bclient\b")]), [("Gradle client bump", "build"), ("New client", "client"), ("else", "other")])
cases("str_26_rejection", "x string, y array<string>", lambda: D.rejection("x", col("y"), 20), [("Fine text", ["c"], "~"), ("Fine text", [], "uncited"), ("This should go", ["c"], "stance"), ("x" * 21, ["c"], "length"), (" ", ["c"], "length")])
cases("str_27_completion", "x string", lambda: D.completion_form("x", ["was merged", "shipped"], ["may", "will"]), [("It was merged today", "was merged"), ("It may have shipped; it Shipped", "shipped"), ("it will have shipped", "~"), ("no", "~")])
cases("str_40_rendered", "x string, y array<string>", lambda: D.rendered(col("x"), col("y"), 2, 5), [("T", ["abcdefg", "b", "c"], "T\n- abcd…\n- b\n… 1 more"), ("T", [], "T")])
cases("ops_12_continuation", "x int, y int, z string", lambda: M.continuation(col("x"), col("y"), F.to_timestamp(col("z")), F.lit("2024-01-20 12:00:00").cast("timestamp"), 60), [(5, 5, None, "~"), (4, 5, None, "2024-01-20T12:00:00.000Z"), (4, 5, "2024-01-20 11:30:00", "2024-01-20T12:30:00.000Z"), (4, 5, "2024-01-19 11:30:00", "2024-01-20T12:00:00.000Z")])
cases("ops_13_halves", "x array<string>, y boolean", lambda: F.to_json(M.halves(col("x"), col("y"))), [(["a", "b", "c"], True, '[["a","b"],["c"]]'), (["a"], True, "[]"), (["a", "b"], False, "[]")])
cases("ops_16_cache", "x string, y boolean", lambda: M.cache_source(F.to_timestamp(col("x")), col("y"), F.lit("2024-01-20 12:00:00").cast("timestamp")), [("2024-01-20 01:00:00", False, "cache"), ("2024-01-18 01:00:00", True, "fetch"), ("2024-01-18 01:00:00", False, "stale"), (None, False, "none")])
cases("ops_20_months", "x string, y string", lambda: M.month_span(F.to_timestamp(col("x")), F.to_timestamp(col("y"))), [("2023-11-30", "2024-01-01", "2023-11|2023-12|2024-01"), ("2024-02-01", "2024-01-01", "")])
cases("set_03_identity", "x string, y string, z string", lambda: R.dedupe_identity("x", "y", "z") == R.dedupe_identity("y", "x", "z"), [("a", "a", "b", "true"), ("a", "b", "c", "false"), ("a:1", "", "", "false"), ("", None, "b", "true")])
