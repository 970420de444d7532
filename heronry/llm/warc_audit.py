"""WARC fixity audit by Merkle trees over ordered offset ranges.

Pages become WARC resource records in archives of `PER_ARCHIVE` consecutive page ids; an archive with many distinct records is split
into parts of about `PER_PART` by record hash, as the sound replica counts them, so no page makes an unbounded group. A part's records
are ordered by (page_id, url, SHA-256 of the record), and their offsets follow from that order.

A tree's leaves are record hashes; a node covers the offset range of `SPAN` consecutive page ids and hashes the length and the ordered
records of its range; a part's root hashes its nodes. Two replicas' roots are compared first, then the nodes of differing parts, then
the records of differing nodes, so sound parts cost one row each. Nodes are told by their page ids and hash the lengths of ranges, not
where they begin: a missing or surplus record changes its own node alone, not all that stand behind it. Records of differing nodes
are matched by content; what is left over on both sides at one page_id and url is corrupt, the rest is missing or surplus.

Records travel as hash, length and id: their bytes stay in the task that reads them. Identical records of one page are counted
at the map side and stored once with their number (`copies`), which is part of the leaf: a lost or added copy is a row of its own with
the number of copies that differ. Null page_id goes to one of 1024 negative archives by url, which a fault of the html does
not change; null url or html counts as empty; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.llm.common import table
from heronry.scratch import persisted

PER_ARCHIVE, SPAN = 256, 16
PER_PART = 4096
PAGE = ["archive", "page_id", "url_md5"]
RECORD = [*PAGE, "length", "digest"]


def record_text(url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record; the date is fixed so that equal pages give equal records."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _number(hexadecimal: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")


def records(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """archive, node, page_id, url_md5, length, digest, copies of every distinct record."""
    record = record_text(F.col("url"), F.col("html") if html is None else html)
    url = F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary"))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url_md5"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"))
    distinct = hashed.groupBy("page_id", "url_md5", "length", "digest").agg(F.count("*").alias("copies"))
    archive = F.coalesce(F.floor(F.col("page_id") / PER_ARCHIVE), -1 - _number(F.col("url_md5")) % 1024).cast("long")
    node = F.coalesce(F.expr(f"pmod(page_id, {PER_ARCHIVE}) DIV {SPAN}"), F.lit(0)).cast("long")
    return distinct.select(archive.alias("archive"), node.alias("node"), *RECORD[1:], "copies")


def stored(recs: DataFrame, parts: DataFrame) -> DataFrame:
    """The records with part and offset."""
    placed = recs.join(parts, "archive", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(_number(F.col("digest")) % F.col("parts")).cast("long")).drop("parts")
    order = Window.partitionBy("archive", "part").orderBy("page_id", "url_md5", "digest").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", (F.sum("length").over(order) - F.col("length")).cast("long"))


def nodes(recs: DataFrame) -> DataFrame:
    """archive, part, node, start, stop (its offset range) and hash."""
    leaves = F.array_sort(F.collect_list(F.struct("page_id", "url_md5", "digest", "copies")))
    ranges = recs.groupBy("archive", "part", "node").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sum("length").alias("bytes"), leaves.alias("leaves"))
    text = F.concat_ws("|", F.col("bytes"), F.concat_ws(",", F.transform("leaves", lambda x: F.concat_ws(" ", x.page_id, x.url_md5, x.digest, x.copies))))
    return ranges.select("archive", "part", "node", "start", "stop", F.sha2(text.cast("binary"), 256).alias("hash"))


def roots(ranges: DataFrame) -> DataFrame:
    """archive, part and the hash over its nodes."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return ranges.groupBy("archive", "part").agg(F.sha2(F.concat_ws(",", F.transform(children, lambda x: F.concat_ws(" ", x.node, x.hash))).cast("binary"), 256).alias("hash"))


def _differing(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose hash differs between two replicas or stands in one alone."""
    hashes = lambda t, side: t.select(*key, F.col("hash").alias(side))
    return hashes(left, "a").join(hashes(right, "b"), key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def located(left: DataFrame, right: DataFrame) -> DataFrame:
    """Corrupt, missing and surplus records, from two replicas' record tables (the first is the sound one)."""
    parts = left.groupBy("archive").agg(F.ceil(F.count("*") / PER_PART).alias("parts")).filter("parts > 1")
    a, b = (persisted(stored(side, parts), "records") for side in (left, right))
    ranges = [persisted(nodes(side), "nodes") for side in (a, b)]
    parts = _differing(*map(roots, ranges), ["archive", "part"])
    bad = _differing(*[r.join(parts, ["archive", "part"], "left_semi") for r in ranges], ["archive", "part", "node"])
    suspects = [persisted(side.join(bad, ["archive", "part", "node"], "left_semi"), "suspects") for side in (a, b)]

    def alone(side: DataFrame, other: DataFrame, name: str) -> DataFrame:
        """Records of which one replica has more copies than the other, with how many more, numbered within their page and url."""
        known = other.select(*[F.col(c).alias(f"other_{c}") for c in (*RECORD, "copies")])
        same = [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in RECORD]
        more = side.join(known, same, "left").withColumn("copies", F.col("copies") - F.coalesce("other_copies", F.lit(0))).filter("copies > 0")
        left_over = more.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE).orderBy("digest")))
        return left_over.select(*[F.col(c).alias(f"{c}_{name}") for c in ("part", *RECORD, "offset", "copies", "nth")])

    x, y = alone(*suspects, "a"), alone(*suspects[::-1], "b")
    both = x.join(y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in (*PAGE, "nth")], "full_outer")
    sound, found = F.coalesce("copies_a", F.lit(0)), F.coalesce("copies_b", F.lit(0))
    kinds = [("corrupt", F.least(sound, found)), ("missing", sound - found), ("surplus", found - sound)]
    told = both.withColumn("k", F.explode(F.array(*[F.struct(F.lit(status).alias("status"), copies.alias("copies")) for status, copies in kinds]))).filter("k.copies > 0")
    own = F.col("k.status") == "surplus"
    pick = lambda c: F.when(own, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(c)
    expected, seen = F.when(~own, F.col("digest_a")), F.when(F.col("k.status") != "missing", F.col("digest_b"))
    return told.select(pick("archive"), pick("part"), pick("page_id"), pick("offset"), pick("length"), F.col("k.copies").alias("copies"), expected.alias("expected_sha256"), seen.alias("found_sha256"), F.col("k.status").alias("status"))


def faulty(html: Column, url: Column) -> Column:
    """The fault of the audited replica: the first character of every page whose url's SHA-256 begins with 0 reads ~."""
    hit = F.sha2(F.coalesce(url, F.lit("")).cast("binary"), 256).startswith("0") & (F.length(html) > 0)
    return F.when(hit, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(html)


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica with known faults against the sound one, over all pages.

    Besides the changed pages, the sound replica has two copies of every page whose url's SHA-256 begins with 1, of which the other has
    lost one, and the other has two of those whose digest begins with 2.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.substring(F.sha2(F.coalesce("url", F.lit("")).cast("binary"), 256), 1, 1)
    twice = lambda digit: pages.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(mark == digit, 2).otherwise(1))))
    return located(records(twice("1")), records(twice("2"), faulty(F.col("html"), F.col("url"))))


OP10_SQL = """
WITH r AS (
  SELECT page_id, url, coalesce(html, '') AS good,
         CASE WHEN substr(sha256(coalesce(url, '')), 1, 1) = '0' AND length(html) > 0 THEN '~' || substr(html, 2) ELSE coalesce(html, '') END AS bad
  FROM pages),
t AS (
  SELECT page_id, md5(coalesce(url, '')) AS url_md5, v.kind, unnest(range(CASE WHEN substr(sha256(coalesce(url, '')), 1, 1) = v.twice THEN 2 ELSE 1 END)) AS copy, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(v.body)::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || v.body || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM r, LATERAL (SELECT 'a' AS kind, good AS body, '1' AS twice UNION ALL SELECT 'b', bad, '2') v),
d AS (
  SELECT kind, coalesce(floor(page_id / 256.0)::BIGINT, -1 - ('0x' || substr(url_md5, 1, 8))::BIGINT % 1024) AS archive, page_id, url_md5,
         strlen(record)::BIGINT AS length, sha256(record) AS digest, count(*)::BIGINT AS copies
  FROM t GROUP BY ALL),
n AS (SELECT archive, ceil(count(*) / 4096.0)::BIGINT AS parts FROM d WHERE kind = 'a' GROUP BY archive),
p AS (SELECT d.*, coalesce(('0x' || substr(digest, 1, 8))::BIGINT % parts, 0) AS part FROM d LEFT JOIN n USING (archive)),
o AS (
  SELECT *, (sum(length) OVER w - length)::BIGINT AS "offset"
  FROM p WINDOW w AS (PARTITION BY kind, archive, part ORDER BY page_id NULLS FIRST, url_md5, digest ROWS UNBOUNDED PRECEDING)),
m AS (
  SELECT x.* EXCLUDE (copies), x.copies - coalesce(y.copies, 0) AS more FROM o x LEFT JOIN o y ON y.kind <> x.kind AND y.archive = x.archive AND y.page_id IS NOT DISTINCT FROM x.page_id
    AND y.url_md5 = x.url_md5 AND y.length = x.length AND y.digest = x.digest),
u AS (SELECT *, row_number() OVER (PARTITION BY kind, archive, page_id, url_md5 ORDER BY digest) AS nth FROM m WHERE more > 0),
b AS (
  SELECT a.* RENAME (more AS more_a, digest AS digest_a), b.archive AS archive_b, b.part AS part_b, b.page_id AS page_id_b, b."offset" AS offset_b, b.length AS length_b, b.digest AS digest_b, b.more AS more_b
  FROM (SELECT * FROM u WHERE kind = 'a') a FULL JOIN (SELECT * FROM u WHERE kind = 'b') b
    ON a.archive = b.archive AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.url_md5 = b.url_md5 AND a.nth = b.nth)
SELECT archive, part, page_id, "offset", length, least(more_a, more_b) AS copies, digest_a AS expected_sha256, digest_b AS found_sha256, 'corrupt' AS status FROM b WHERE more_a IS NOT NULL AND more_b IS NOT NULL
UNION ALL SELECT archive, part, page_id, "offset", length, more_a - coalesce(more_b, 0), digest_a, NULL, 'missing' FROM b WHERE more_a > coalesce(more_b, 0)
UNION ALL SELECT archive_b, part_b, page_id_b, offset_b, length_b, more_b - coalesce(more_a, 0), NULL, digest_b, 'surplus' FROM b WHERE more_b > coalesce(more_a, 0)
"""
