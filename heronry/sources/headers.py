"""The header of wiki pages: who a page names as its authors and which issues it belongs to, read from HTML inside Arrow batches.

A reader follows the tags of a page with Python's own HTML parser. The header ends at the heading behind a 'Status' heading, or at the
first heading where there is none. Its blocks are paragraphs and table cells, the inner ones first, without text of headings; a block
whose text begins with 'Author:' or the like names authors, one that begins with 'Jira' has the issue keys.

A page without HTML, or without such blocks, has status 'no-list' and jira 'none'; unclosed tags end with the page; names that don't
look like names make the whole list 'unparsed'. A page is read in one pass whatever its length.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How an author line begins, and what one name is: one to five words of letters, dots, hyphens and apostrophes (fixed values).
AUTHOR_LABEL = re.compile(r"^(?:co-)?authors?\s*:", re.IGNORECASE)
HEADER = "status string, authors array<string>, jira string, keys array<string>"
HEADINGS = {f"h{k}" for k in range(1, 7)}
CELLS = {"p", "td", "th"}


@dataclass
class Block:
    """Runs of a block: text, or the name in a mention of a user."""

    runs: list[tuple[str, bool]] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    asks: bool = False  # holds a search for issues instead of keys

    @property
    def plain(self) -> str:
        return " ".join("".join(f" {t} " if mention else t for t, mention in self.runs).split())


class HeaderReader(HTMLParser):
    """Blocks of the header, each when it closes."""

    def __init__(self, project: str):
        super().__init__(convert_charrefs=True)
        self.key = re.compile(rf"\b{re.escape(project)}-\d+\b")
        self.open: list[Block] = []
        self.blocks: list[Block] = []
        self.headings = 0  # how many are open
        self.heading: list[str] = []
        self.marks: list[tuple[int, str]] = []  # blocks closed before each heading, and its text
        self.snapshots: list[list[Block]] = []  # blocks that are open there, the inner ones first
        self.mention: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in HEADINGS:
            if not self.headings:
                self.marks.append((len(self.blocks), ""))
                self.snapshots.append([Block(list(b.runs), list(b.keys), b.asks) for b in reversed(self.open)])
                self.heading = []
            self.headings += 1
        elif tag in CELLS:
            self.open.append(Block())
        elif tag == "br":
            self._add(" ", False)
        elif tag == "a" and "user-mention" in (dict(attrs).get("class") or "").split():
            self.mention = []
        else:
            named = dict(attrs)
            found = [k for name in ("data-jira-key", "href") for k in self.key.findall(named.get(name) or "")]
            asks = named.get("data-macro-name") == "jira" and named.get("data-jira-key") is None
            for block in self.open:
                block.keys += found
                block.asks |= asks

    def handle_endtag(self, tag):
        if tag in HEADINGS and self.headings:
            self.headings -= 1
            if not self.headings:
                self.marks[-1] = (self.marks[-1][0], " ".join("".join(self.heading).split()).lower())
        elif tag in CELLS and self.open:
            self.blocks.append(self.open.pop())
        elif tag == "a" and self.mention is not None:
            name, self.mention = "".join(self.mention), None
            self._add(name, True)

    def handle_data(self, data):
        if self.headings:
            self.heading.append(data)
        elif self.mention is not None:
            self.mention.append(data)
        else:
            self._add(data, False)

    def _add(self, data: str, mention: bool):
        if not self.headings and (self.mention is None or mention):
            for block in self.open:
                block.runs.append((data, mention))
                if not mention:
                    block.keys += self.key.findall(data)

    def header(self) -> list[Block]:
        """The blocks before the heading that ends the header; those still open there count as closed."""
        self.close()
        status = next((i for i, (_, name) in enumerate(self.marks) if name == "status"), None)
        end = 0 if status is None else status + 1
        if end >= len(self.marks):
            return self.blocks + self.open[::-1]
        return self.blocks[: self.marks[end][0]] + self.snapshots[end]


def _is_name(part: str) -> bool:
    words = part.split(" ")
    return len(words) <= 5 and all(w and all(c.isalpha() or c in ".'-" or unicodedata.category(c).startswith("M") for c in w) for w in words) and any(c.isalpha() for c in part)


def author_names(block: Block) -> list[str] | None:
    """The names of an author block, in order; None where a part is no name. Addresses are left out, bracketed parts are parts."""
    parts, label = [], True
    for run, mention in block.runs:
        if mention:
            parts.append([run])
            continue
        piece = run
        if label:
            stripped = piece.lstrip()
            hit = AUTHOR_LABEL.match(stripped)
            if hit:
                piece, label = stripped[hit.end() :], False
        piece = re.sub(r"<[^<>]*>", ",", piece)
        parts.append(re.split(r"[,;&()]|\s+and\s+", piece))
    names: list[str] = []
    joined: list[tuple[str, bool]] = []  # a name that tags cut into runs is one part
    for index, part in enumerate(parts):
        mention = block.runs[index][1]
        for k, text in enumerate(part):
            if k == 0 and joined and not mention and not joined[-1][1]:
                joined[-1] = (joined[-1][0] + text, False)
            else:
                joined.append((text, mention))
    for text, _ in joined:
        name = " ".join(text.split())
        if name and not set(name) & set("@<>"):
            names.append(name)
    return names if names and all(map(_is_name, names)) else None


def read_header(html: str, project: str) -> tuple[str, list[str], str, list[str]]:
    """status, authors, jira, keys of one page."""
    reader = HeaderReader(project)
    reader.feed(html)
    blocks = reader.header()
    status, authors = "no-list", []
    block = next((b for b in blocks if AUTHOR_LABEL.match(b.plain)), None)
    if block is not None:
        names = author_names(block)
        status, authors = ("unparsed", []) if names is None else ("listed", names)
    field_ = next((b for b in blocks if b.plain.lower().startswith("jira")), None)
    if field_ is None:
        return status, authors, "none", []
    keys = [k for k in dict.fromkeys(field_.keys) if k != f"{project}-1"]  # the template's own example
    kind = {0: "query" if field_.asks else "empty", 1: "one"}.get(len(keys), "several")
    return status, authors, kind, keys


def page_headers(pages: DataFrame, key: str, html: str, project: str) -> DataFrame:
    """key, status, authors, jira, keys of every page."""

    def run(batches):
        for batch in batches:
            told = [read_header(h or "", project) for h in batch.column("html").to_pylist()]
            columns = zip(*told, strict=True) if told else [[], [], [], []]
            kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["key", "status", "authors", "jira", "keys"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {HEADER}")
