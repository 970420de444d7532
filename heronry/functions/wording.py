"""Rules over titles, mails, names and sentences, as columns that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions.text import numbered_proposals, text

#: Tags that mail gateways add, and reply and forward prefixes of several languages (fixed values).
GATEWAY_TAGS = ["external", "ext", "external email", "external sender", "caution"]
REPLY_PREFIXES = ["re", "fw", "fwd", "aw", "sv", "vs", "wg", "antw", "rif", "tr"]
#: What may follow the sign of a vote; words that leave a +1 clear; where the quoted mail below begins (fixed values).
AFTER_SIGN = "(,.!:;"
CLEAR_WORDS = ["from me", "thank", "thanks", "lgtm"]
QUOTE_HEADERS = r"(?i)^\s*-{2,}\s*Original Message|^\s*From:\s"
#: Status classes in order, with their words (fixed values).
STATUS = [
    ("Early Access", r"early\s*access"),
    ("Adopted", r"\b(?:adopted|accepted|released|implemented|completed|merged)\b"),
    ("Discarded", r"\b(?:discarded|rejected|superseded|withdrawn|abandoned|inactive|moved|dormant|dead)\b"),
    ("Under Discussion", r"\b(?:under\s*discussion|discussion|discussing|draft|voting|vote|wip|in\s*progress)\b"),
]
#: Words that tell nothing about a title (fixed values).
STOP_WORDS = "a an and are as at be by for from in into is it its of on or re the to via when with without minor wip draft discuss vote result pr add use not all after before per can do does should".split()
#: Verbs that report a person's words; words that fill a sentence; identifiers (fixed values).
REPORTING = "said asked proposed questioned discussed suggested noted argued requested introduced congratulated".split()
FILLERS = "merged open opened closed resolved proposed proposes released pending remains approved is are was were be been has have would will a an the to of for in on at by with and or as from apache kafka".split()
IDENTIFIER = r"^(?:[A-Z][A-Z0-9]*-(?:PR-|ISSUE-|MAIL-)?[0-9a-f]+|#\d+|v?\d+(?:\.\d+)+|RC\d*)$"
#: Authors who are nobody (fixed values).
NOBODY = ["", "unknown", "unknown sender", "ghost"]


def collapsed(c) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def member_key(c) -> Column:
    """The subject without leading gateway tags and reply prefixes, collapsed, in lower case."""
    lead = rf"\[(?:{'|'.join(GATEWAY_TAGS)})\]|(?:{'|'.join(REPLY_PREFIXES)})\s*:"
    return F.lower(F.trim(F.regexp_replace(collapsed(c), rf"(?i)^(?:(?:{lead})\s*)+", "")))


def has_tag(c, tag: str) -> Column:
    return F.contains(F.lower(text(c)), F.lit(f"[{tag.lower()}]"))


def discussed_proposal(c) -> Column:
    """The one proposal that a title opens a discussion of; null if it names none or several."""
    ids = numbered_proposals(c)
    return F.when(F.trim(text(c)).rlike(r"(?i)^(?:\[discuss\]|discuss:)") & (F.size(ids) == 1), F.get(ids, 0))


def proposal_title(c) -> Column:
    return F.regexp_replace(text(c), r"(?i)^\s*(?:\[DISCUSS\]|DISCUSS\s*:)?\s*KIP-\d+\s*[:：-]?\s*", "")


def _vote_of(line: Column) -> Column:
    """struct(sign, marker, plain, line) of one line: sign is empty where it is no vote, plain tells that nothing follows which may qualify it."""
    trimmed = F.trim(line)
    sign = F.when(F.trim(F.regexp_replace(line, "^\\s+", "")).rlike(rf"^[+-]1(?:$|[\s{AFTER_SIGN}])"), F.substring(F.regexp_replace(line, "^\\s+", ""), 1, 2)).otherwise("")
    behind = F.regexp_replace(F.regexp_replace(line, r"^\s*[+-]1", ""), r"^\s*,?\s*", "")
    #: 'binding' with or without its first n, in brackets or as a word (fixed values).
    bound = r"(?i)^(?:\(\s*(non[-\s]?)?bin?ding\s*\)|(non[-\s]?)?bin?ding\b)"
    marker = F.when(behind.rlike(bound), F.when(F.concat(F.regexp_extract(behind, bound, 1), F.regexp_extract(behind, bound, 2)) != "", "non-binding").otherwise("binding"))
    rest = F.lower(F.regexp_replace(F.regexp_replace(behind, bound, ""), r"^\s+", ""))
    plain = (rest == "") | F.substring(rest, 1, 1).isin(*".!,;)") | rest.rlike(rf"^(?:{'|'.join(CLEAR_WORDS)})\b")
    return F.struct(sign.alias("sign"), marker.alias("marker"), plain.alias("plain"), trimmed.alias("line"))


def votes(body) -> Column:
    """struct(votes: array of vote, marker, line; unclear: lines; ambiguous) of a mail's body.

    A -1 always counts, a +1 where nothing qualifies it; the others are unclear. Behind the header of a quoted mail no vote is
    read, and a vote line there makes the mail ambiguous.
    """
    lines = F.split(text(body), r"\r?\n")
    headers = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(QUOTE_HEADERS))
    own = F.coalesce(F.get(headers, 0), F.size(lines))
    signed = lambda part: F.filter(F.transform(part, _vote_of), lambda v: v["sign"] != "")
    read, quoted = signed(F.slice(lines, 1, own)), signed(F.slice(lines, own + 1, F.size(lines)))
    counts = lambda v: (v["sign"] == "-1") | v["plain"]
    return F.struct(
        F.transform(F.filter(read, counts), lambda v: F.struct(v["sign"].alias("vote"), v["marker"].alias("marker"), v["line"].alias("line"))).alias("votes"),
        F.transform(F.filter(read, lambda v: ~counts(v)), lambda v: v["line"]).alias("unclear"),
        (F.size(quoted) > 0).alias("ambiguous"),
    )


def status_of(c) -> Column:
    low, out = F.lower(text(c)), F.lit("Unknown")
    for name, words in reversed(STATUS):
        out = F.when(low.rlike(words), name).otherwise(out)
    return out


def wiki_status(c) -> Column:
    """What stands behind 'Current state' on a wiki page; null where nothing does."""
    plain = F.replace(F.regexp_replace(text(c), r"<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" "))
    found = F.regexp_extract(plain, r"Current state[:\s]+([A-Za-z][A-Za-z /()-]*?)(?:\s{2,}|$|\.)", 1)
    return F.when(found != "", F.trim(found))


def reviewers(c) -> Column:
    """Names of 'Reviewers:' lines, in order, without addresses."""
    lines = F.regexp_extract_all(text(c), F.lit(r"(?im)^[ \t]*reviewers?:[ \t]*(.+)$"), F.lit(1))
    names = F.flatten(F.transform(lines, lambda x: F.split(x, ",")))
    plain = F.transform(names, lambda n: collapsed(F.regexp_replace(n, r"<[^>]*>|\S*@\S*", " ")))
    return F.filter(plain, lambda n: n != "")


def person_id(source: Column, author: Column) -> Column:
    """source:name, the login or the name without quotes, in lower case; null for nobody."""
    name = F.when(source == "github", F.lower(F.trim(author))).otherwise(F.lower(collapsed(F.regexp_replace(author, r"[\"']", ""))))
    known = ~name.isin(NOBODY) & (F.length(name) <= 200) & ~name.rlike(r"[\x{00}-\x{1f}]")
    return F.when(known, F.concat(source, F.lit(":"), name))


def person_key(c) -> Column:
    """The login that a query names; null if it can't be one."""
    key = F.lower(F.regexp_replace(F.trim(text(c)), "^@", ""))
    return F.when(key.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,38})$"), key)


#: Identifiers, part numbers and issue numbers that tell nothing about a title (fixed values).
UNTELLING = [r"\b(?:KIP|KAFKA|FLIP|PR|ISSUE)-\d+\b", r"\[\d+/(?:[Nn]|\d+)\]", r"#\d+"]


def title_terms(c) -> Column:
    """Distinct telling terms of a title, in order: no ids, numbers or stop words; versions stay whole, camel case is split."""
    telling = text(c)
    for pattern in UNTELLING:
        telling = F.regexp_replace(telling, pattern, " ")
    # A dot ends a word, but for those inside a token of digits and dots alone: they are kept aside as another character.
    chunks = F.filter(F.split(telling, r"[^A-Za-z0-9_.-]+"), lambda x: x != "")
    versions = F.transform(chunks, lambda x: F.when(x.rlike(r"^[0-9]+(\.[0-9]+)+$"), F.translate(x, ".", "·")).otherwise(x))
    words = F.split(F.array_join(versions, "."), r"\.")
    cased = F.transform(words, lambda w: F.when(w.rlike("[a-z][A-Z]"), F.regexp_replace(w, "([a-z0-9])(?=[A-Z])", "$1.")).otherwise(w))
    terms = F.transform(F.split(F.array_join(cased, "."), r"\."), lambda w: F.translate(F.lower(F.btrim(w, F.lit("-"))), "·", "."))
    return F.array_except(F.filter(terms, lambda t: (F.length(t) > 1) & t.rlike("[^0-9]")), F.array(*map(F.lit, STOP_WORDS)))


def person_led(c) -> Column:
    """Whether a sentence tells what a person said: it ends in ', said X', or one of its first six words is a reporting verb."""
    head = F.substring_index(F.regexp_replace(F.trim(text(c)), r"\s+", " "), " ", 6)
    words = F.split(F.regexp_replace(F.lower(head), r"[^\p{L}\p{N} -]", ""), " ")
    tail = F.trim(F.substring_index(text(c), ",", -1))
    closing = F.contains(text(c), F.lit(",")) & tail.rlike(r"(?i)^said\s+[^.]+\.?$")
    return closing | F.arrays_overlap(words, F.array(*map(F.lit, REPORTING)))


def content_free(c) -> Column:
    """Fewer than three words that are neither identifiers, versions nor fillers."""
    spaced = F.regexp_replace(text(c), r"[\s,;:()]+", " ")
    bare = F.regexp_replace(F.regexp_replace(spaced, r"(?<![^ ])[^\p{L}\p{N}# ]+", ""), r"[^\p{L}\p{N} ]+(?![^ ])", "")
    words = F.filter(F.split(bare, " "), lambda w: (w != "") & ~w.rlike(IDENTIFIER))
    fillers = F.array(*map(F.lit, FILLERS))
    return F.size(F.filter(words, lambda w: ~F.array_contains(fillers, F.lower(w)))) < 3


def entities_decoded(c) -> Column:
    """Named and numeric HTML entities of the basic set as characters."""
    out = text(c)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")):
        out = F.regexp_replace(out, f"(?i){entity}", char)
    return out


def protected(c, names: list[str]) -> Column:
    """Each name as a numbered placeholder, longest first, so that a translation can't change it."""
    out = text(c)
    for k, name in sorted(enumerate(names), key=lambda x: -len(x[1])):
        out = F.replace(out, F.lit(name), F.lit(f"⟦{k}⟧"))
    return out


def restored(c, names: list[str]) -> Column:
    out = text(c)
    for k, name in enumerate(names):
        out = F.replace(out, F.lit(f"⟦{k}⟧"), F.lit(name))
    return out


def is_learned_bot(login: Column, learned: Column, listed: list[str] = ()) -> Column:
    """A listed login, a [bot] suffix, or one that data have typed Bot (`learned`: boolean column)."""
    return F.lower(login).endswith("[bot]") | F.lower(login).isin([x.lower() for x in listed] or ["\u0000"]) | F.coalesce(learned, F.lit(False))


def areas(labels: Column, ids: Column, process: list[str], id_pattern: str = r"^kip-?(\d+)$") -> Column:
    """struct(labels, ids): area labels, and proposal ids of titles and labels by number; process labels go."""
    number = lambda x: F.regexp_extract(x, f"(?i){id_pattern}", 1)
    of_labels = F.transform(F.filter(labels, lambda x: number(x) != ""), lambda x: F.concat(F.lit("KIP-"), number(x)))
    rest = F.filter(labels, lambda x: (number(x) == "") & ~x.isin(process))
    numbers = F.array_sort(F.array_distinct(F.transform(F.concat(ids, of_labels), lambda x: F.substring(x, 5, 20).cast("int"))))
    return F.struct(F.array_sort(F.array_distinct(rest)).alias("labels"), F.transform(numbers, lambda n: F.concat(F.lit("KIP-"), n)).alias("ids"))
