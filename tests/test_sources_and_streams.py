"""Captures read from JSON pages, and counts per window of a stream's rows."""

import json

import pytest
from pyspark.sql import functions as F

from heronry.sources import captures


def page(path, mails, hits):
    path.mkdir(exist_ok=True)
    (path / "p1.json").write_text(json.dumps({"hits": hits, "emails": mails}))
    return str(path)


def mail(mid, epoch, subject):
    return {"mid": mid, "epoch": epoch, "subject": subject, "from": "Ann <ann@example.org>", "body": None}


def test_mail_states_and_repeats(spark, tmp_path):
    mails = [mail("a", 1000, "Plans"), mail("b", 10, "Plans"), mail("c", 1000, "[jira] Created"), mail("a", 1000, "Plans")]
    rows = captures.mail_events(spark, page(tmp_path / "m", mails, 4), F.timestamp_seconds(F.lit(500))).collect()
    assert {(r.id, r.state) for r in rows} == {("a", "event"), ("b", "outside"), ("c", "filtered")}


def test_incomplete_page_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="incomplete"):
        captures.mail_events(spark, page(tmp_path / "m", [mail("a", 1, "x")], 2), F.timestamp_seconds(F.lit(0))).collect()


def test_issues_with_and_without_comments(spark, tmp_path):
    issue = lambda key, comment: {"key": key, "fields": {"summary": "s", "reporter": {"displayName": "Ann"}, "comment": comment}}
    told = {"comments": [{"id": "1", "author": {"displayName": "Bo"}, "body": "b", "created": "x"}]}
    (tmp_path / "i").mkdir()
    (tmp_path / "i/p.json").write_text(json.dumps({"total": 3, "issues": [issue("K-1", told), issue("K-2", {"comments": []}), issue("K-3", None)]}))
    rows = captures.issue_events(captures.read_issues(spark, str(tmp_path / "i"))).collect()
    assert sorted(r.id for r in rows) == ["comment-K-1-1", "issue-K-1", "issue-K-2", "issue-K-3"]
