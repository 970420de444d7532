"""Pages that were fetched as JSON or HTML, as rows: pull lists, rosters, thread trees, wiki links, reviews, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated_pulls(items: DataFrame, since: Column, most: int) -> DataFrame:
    """number, updated_at of the pull requests to read: those changed after the cursor, oldest first, at most `most`.

    items: number, updated_at, is_pull. An item that several pages list counts once, with its newest change.
    """
    pulls = items.filter("is_pull").groupBy("number").agg(F.max("updated_at").alias("updated_at")).filter(F.col("updated_at") >= since)
    return pulls.orderBy("updated_at", "number").limit(most)


def next_cursor(read: DataFrame, previous: Column) -> DataFrame:
    """One row: the cursor after a read, which never moves back."""
    return read.agg(F.greatest(previous, F.max("updated_at")).alias("cursor"))


def next_page(items: DataFrame, since: Column, page: int, full: int) -> DataFrame:
    """One row (since, page): a full page that moved on in time continues from its last second, else on the next page."""
    last = F.max("updated_at")
    moved = (F.count("*") >= full) & (last - F.expr("interval 1 second") > since)
    return items.agg(F.when(moved, last - F.expr("interval 1 second")).otherwise(since).alias("since"), F.when(moved, 1).otherwise(page + 1).alias("page"))


def page_union(pages: DataFrame) -> DataFrame:
    """One row a pull request number of (page, number, ...): that of the first page."""
    first = pages.groupBy("number").agg(F.min_by(F.struct(*pages.columns), "page").alias("r"))
    return first.select("r.*")


@F.udtf(returnType="depth: int, place: int, id: string, body: string")
class FlatThread:
    """All messages of a thread tree (JSON with children) in reading order, to any depth."""

    def eval(self, tree: str):
        import json

        stack, place = [(0, json.loads(tree))] if tree else [], 0
        while stack:
            depth, node = stack.pop()
            yield depth, place, node.get("id"), node.get("body")
            place += 1
            stack += [(depth + 1, child) for child in reversed(node.get("children") or [])]


def roster(projects: DataFrame, people: DataFrame) -> DataFrame:
    """login, name, roles: members and owners of projects (project, members, owners), with their names where known."""
    of = lambda column, role: projects.select(F.explode(column).alias("login"), F.lit(role).alias("role"))
    roles = of("members", "committer").unionByName(of("owners", "pmc")).groupBy("login").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return roles.join(people.select("login", "name"), "login", "left").select("login", "name", "roles")


def committers(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """name, login of every match of a page's pattern with the two as groups."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("login"))
    return pages.select(F.explode(found).alias("m")).select(F.trim("m.name").alias("name"), F.trim("m.login").alias("login"))


def proposal_links(pages: DataFrame, html: str, patterns: list[str]) -> DataFrame:
    """number, title of the proposals that pages link to, by several patterns (number and title as groups); the longest title stands."""
    rows = None
    for pattern in patterns:
        zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("t"))
        part = pages.select(F.explode(zipped).alias("m")).select(F.col("m.n").cast("int").alias("number"), F.trim("m.t").alias("title"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("number").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("title"))


REVIEWS = "struct<data: struct<repository: struct<nodes: array<struct<number: int, reviews: array<struct<id: string, state: string, author: string>>>>>>, errors: array<struct<path: array<string>, message: string>>>"


def review_page(pages: DataFrame, body: str) -> DataFrame:
    """number, id, state, author of parsed pages; an error that names no node fails, a node that an error names is left out."""
    parsed = pages.select(F.from_json(body, REVIEWS).alias("p")).select("p.data.repository.nodes", F.coalesce("p.errors", F.expr("cast(array() AS array<struct<path: array<string>, message: string>>)")).alias("errors"))
    whole = F.filter("errors", lambda e: e["path"].isNull() | (F.size(e["path"]) < 3))
    nodes = F.when(F.size(whole) > 0, F.raise_error(F.concat(F.lit("the page failed: "), F.get(whole, 0)["message"]))).otherwise(F.col("nodes"))
    bad = F.transform("errors", lambda e: F.get(e["path"], 2).cast("int"))
    rows = parsed.select(nodes.alias("nodes"), bad.alias("bad")).select("bad", F.posexplode("nodes").alias("at", "n")).filter(~F.array_contains("bad", F.col("at")))
    return rows.select("n.number", F.explode("n.reviews").alias("r")).select("number", "r.*")


def changed_pages(state: DataFrame, pages: DataFrame) -> DataFrame:
    """id, change of polled pages (id, version) against what is stored: new, changed, or drifted where the version went back."""
    both = pages.join(state.select("id", F.col("version").alias("stored")), "id", "left")
    change = F.when(F.col("stored").isNull(), "new").when(F.col("version") > F.col("stored"), "changed").when(F.col("version") < F.col("stored"), "drifted")
    return both.select("id", change.alias("change")).filter("change IS NOT NULL")


def usage_totals(rows: DataFrame, now: Column) -> DataFrame:
    """One row: requests in now's month, in the last seven whole days and the last 24 hours, and bytes as each bucket's newest row has them."""
    at, n = F.col("at"), F.col("requests")
    today = F.date_trunc("day", now)
    counted = rows.agg(
        F.coalesce(F.sum(F.when((at >= F.date_trunc("month", now)) & (at <= now), n)), F.lit(0)).alias("month"),
        F.coalesce(F.sum(F.when((at >= today - F.expr("interval 7 days")) & (at < today), n)), F.lit(0)).alias("week"),
        F.coalesce(F.sum(F.when((at > now - F.expr("interval 1 day")) & (at <= now), n)), F.lit(0)).alias("day"),
    )
    stored = rows.groupBy("bucket").agg(F.max_by("bytes", "at").alias("bytes")).agg(F.sum("bytes").alias("bytes"))
    return counted.join(F.broadcast(stored))  # a row on each side


def history(rows: DataFrame, job: str, since: Column, most: int = 20) -> DataFrame:
    """at, status, n of a job's runs since an instant, newest first, at most `most`: equal rows counted."""
    return rows.filter((F.col("job") == job) & (F.col("at") >= since)).groupBy("at", "status").agg(F.count("*").alias("n")).orderBy(F.desc("at"), "status").limit(most)


def front_matter(files: DataFrame, body: str) -> DataFrame:
    """path, fields (map of the lines between the first two ---), sections (map of heading to text) of Markdown files."""
    head = F.regexp_extract(body, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    section = r"(?ms)^## ([^\n]+)\n(.*?)(?=^## |\z)"
    names, texts = (F.transform(F.regexp_extract_all(body, F.lit(section), F.lit(k)), lambda x: F.trim(x, F.lit(" \n"))) for k in (1, 2))
    return files.select("path", F.map_from_entries(pairs).alias("fields"), F.map_from_arrays(names, texts).alias("sections"))


def unresolved(files: DataFrame, related: str = "related") -> DataFrame:
    """path, id: ids that a file's field `related` names (comma list) and no file has as its field id."""
    named = files.select("path", F.explode(F.split(F.coalesce(F.col("fields")[related], F.lit("")), r"\s*,\s*")).alias("id")).filter("id <> ''")
    return named.join(files.select(F.col("fields")["id"].alias("id")), "id", "left_anti").select("path", "id")
