"""Text functions on columns: tokens, keys, thread titles, plain text, parsers of small formats. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reply and forward prefixes of mail subjects (fixed values).
REPLY_PREFIX = r"(?i)^(\s*(?:re|fwd?|fw|aw)\s*:\s*)+"
RAW_TOKEN = r"[\p{L}\p{N}_]+(?:[.\-][\p{L}\p{N}_]+)*"
#: Places where an identifier in camel case is split.
CASE_EDGE = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: Status words by class, first match wins (fixed values).
STATUS_CLASSES = [("adopted", "adopted|accepted|approved|released|merged"), ("rejected", "reject|declined|withdrawn"), ("inactive", "inactive|dormant|abandon"), ("voting", "vot"), ("discussion", "discuss|draft|wip|under")]
#: Entities that plain text decodes (fixed values); the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def simple_tokens(c) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def raw_tokens(c) -> Column:
    """Runs of letters, digits and underscores, with inner dots and hyphens."""
    return F.regexp_extract_all(text(c), F.lit(RAW_TOKEN), F.lit(0))


def code_tokens(c, split_case: bool = True) -> Column:
    """Each raw token in lower case, then its dot and hyphen parts where there are several, then the words of camel case."""

    def expand(token: Column) -> Column:
        parts = F.filter(F.split(token, r"[.\-_]"), lambda p: p != "")
        whole = F.array(F.lower(token))
        pieces = F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(F.array().cast("array<string>"))
        if not split_case:
            return F.concat(whole, pieces)
        words = F.flatten(F.transform(parts, lambda p: F.filter(F.split(p, CASE_EDGE), lambda w: w != "")))
        return F.concat(whole, pieces, F.when(F.size(words) > F.size(parts), F.transform(words, F.lower)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(raw_tokens(c), expand))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of a word array, in order."""
    n = F.size(words) - 1
    return F.when(n < 1, F.array().cast("array<struct<a:string,b:string>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"))))


def has_adjacent(words: Column, first: str, second: str) -> Column:
    return F.exists(bigrams(words), lambda p: (p["a"] == first) & (p["b"] == second))


def is_structured_query(c) -> Column:
    """One identifier: letters, a hyphen and a number, or a number alone."""
    return F.trim(text(c)).rlike(r"^(?:[A-Za-z]+-\d+|#?\d+)$")


def issue_keys(c) -> Column:
    """Distinct issue keys (PROJECT-123), sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text(c)), F.lit(r"\b[A-Z][A-Z0-9]+-\d+\b"), F.lit(0))))


def numbered_proposals(c, prefix: str = "KIP") -> Column:
    """Distinct proposal ids with a hyphen or a space before the number, as PREFIX-n, sorted."""
    found = F.regexp_extract_all(F.upper(text(c)), F.lit(rf"\b{prefix}[-\s]?(\d+)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.concat(F.lit(f"{prefix}-"), n))))


def thread_title(c) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text(c), REPLY_PREFIX, "")), r"\s+", " ")


def thread_key(c) -> Column:
    return F.lower(thread_title(c))


def is_notification_subject(c) -> Column:
    return thread_title(c).rlike(r"(?i)^\[(?:jira|pr)\]")


def mail_author(c) -> Column:
    """Display name: without address, quotes and a trailing 'via ...'; the address itself where there is no name."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), r"<[^>]*>", ""), r'["]', ""), r"(?i)\s+via\s+.*$", ""))
    return F.when(name == "", F.trim(F.regexp_replace(text(c), r"[<>]", ""))).otherwise(name)


def name_key(c) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text(c), r"[\"'`]", "")), r"\s+", " "))


def activity_person(source: Column, author: Column) -> Column:
    """source:name in lower case; null for an empty author."""
    name = F.lower(F.trim(author))
    return F.when(name != "", F.concat(source, F.lit(":"), name))


def is_machine(author: Column, known: list[str] = ()) -> Column:
    """A [bot] suffix or a listed name; never a substring."""
    return F.lower(author).endswith("[bot]") | F.lower(author).isin([k.lower() for k in known] or ["\u0000"])


def markdown_plain(c, most: int = 360) -> Column:
    """Markdown without code blocks, images, link targets and marks; white space collapsed; clipped with an ellipsis."""
    out = text(c)
    for pattern, to in ((r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "), (r"[*_`>#]+", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    out = F.trim(out)
    return clip(out, most)


def jira_plain(c, most: int = 360) -> Column:
    """Issue tracker markup as plain text."""
    out = text(c)
    for pattern, to in ((r"(?s)\{(code|noformat)[^}]*\}.*?\{\1\}", " "), (r"\{[^}]*\}", " "), (r"\[([^|\]]*)\|[^\]]*\]", "$1"), (r"(?m)^h[1-6]\.\s*", ""), (r"[*_]", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return clip(F.trim(out), most)


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def html_plain(c) -> Column:
    """Tags out, entities decoded, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(c) -> Column:
    return F.trim(F.regexp_extract(text(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r'(?i)href="([^"]+)"'), F.lit(1)))


def status_class(c) -> Column:
    """The first class whose words the status holds; else unknown."""
    low, out = F.lower(text(c)), F.lit("unknown")
    for name, words in reversed(STATUS_CLASSES):
        out = F.when(low.rlike(words), name).otherwise(out)
    return out


def blurb(c, most: int = 180) -> Column:
    """The longest beginning of at most `most` characters that ends before white space."""
    whole = F.trim(text(c))
    cut = F.regexp_extract(whole, rf"(?s)^(.{{1,{most}}})(?=\s)", 1)
    return F.when(F.length(whole) <= most, whole).when(cut != "", F.concat(F.rtrim(cut), F.lit("…"))).otherwise(F.substring(whole, 1, most))


def excerpt(c, terms: list[str], most: int = 240) -> Column:
    """Text around the earliest of the terms, a third of it before the match, with ellipses at cut ends."""
    whole = F.trim(text(c))
    at = F.array_min(F.filter(F.array(*[F.instr(F.lower(whole), t.lower()) for t in terms] or [F.lit(0)]), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - most // 3)
    body = F.trim(F.substring(whole, start, F.lit(most)))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + most - 1 < F.length(whole), "…").otherwise(""))


def redact(c, secrets: list[str]) -> Column:
    out = text(c)
    for secret in secrets:
        out = F.replace(out, F.lit(secret), F.lit("[redacted]"))
    return F.regexp_replace(out, r"(?i)(bearer|token|key)([=:\s]+)[A-Za-z0-9._\-]{16,}", "$1$2[redacted]")


def reviewers(c) -> Column:
    """Names of 'Reviewers:' lines, without addresses."""
    lines = F.regexp_extract_all(text(c), F.lit(r"(?im)^reviewers?:\s*(.+)$"), F.lit(1))
    names = F.flatten(F.transform(lines, lambda x: F.split(x, r"\s*,\s*")))
    return F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"<[^>]*>", ""))), lambda n: n != "")


def vote_of_line(c) -> Column:
    """+1, 0 or -1 of a vote line that isn't quoted; null otherwise."""
    found = F.regexp_extract(text(c), r"^\s*([+-]1|[+-]?0)(?![\d.])", 1)
    return F.when(found != "", F.regexp_replace(found, r"[+]", "").cast("int"))


def is_binding(c) -> Column:
    return text(c).rlike(r"(?i)\(\s*binding\s*\)") & ~text(c).rlike(r"(?i)non[- ]?binding")


def estimate_tokens(c) -> Column:
    """Long identifiers count half their characters, CJK characters one each, the rest a quarter."""
    whole = text(c)
    ids = F.regexp_replace(whole, r"[A-Za-z]+-\d+", "")
    cjk = F.regexp_replace(ids, r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]", "")
    return F.ceil((F.length(whole) - F.length(ids)) / 2 + (F.length(ids) - F.length(cjk)) + F.length(cjk) / 4).cast("long")


def short_id(*parts, size: int = 8) -> Column:
    """The first characters of the SHA-256 of the parts, joined by a zero character."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, size)


def opaque_ref(c: Column) -> Column:
    """URL-safe base64 of a struct's JSON, without padding."""
    return F.rtrim(F.translate(F.base64(F.to_json(c).cast("binary")), "+/=", "-_ "))


def parse_ref(c: Column, schema: str) -> Column:
    body = F.translate(c, "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.unbase64(padded).cast("string"), schema)
