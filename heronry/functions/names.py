"""Public names of people: cleaned, cut between grapheme clusters, and ordered as a reader of the language expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions.text import text

#: Grapheme clusters of a name; letters that look like a blank (fixed values).
LONGEST_NAME = 100
BLANK_LETTERS = "ᅟᅠㅤﾠ⠀"


def display_name(name, login, most: int = LONGEST_NAME) -> Column:
    """The name as it may be shown; null where it tells nothing that the login doesn't.

    Format characters go, but for the joiners that scripts and emoji need; control characters and letters that look blank become
    spaces. The cut never divides a cluster. A name without a letter or digit is none, and neither is one that equals the login or
    holds an @.
    """
    visible = F.regexp_replace(text(name), "[\\p{Cf}&&[^‌‍]]", "")
    spaced = F.trim(F.regexp_replace(visible, rf"[\p{{Cc}}\s{BLANK_LETTERS}]+", " "))
    cut = F.trim(F.regexp_extract(spaced, rf"^\X{{0,{most}}}", 0))
    fine = cut.rlike(r"[\p{L}\p{N}]") & ~F.contains(cut, F.lit("@")) & (F.lower(cut) != F.lower(text(login)))
    return F.when(fine, cut)


def collated(c) -> Column:
    """c so that sorting and comparing follow the Unicode collation: accents after their letter, case after both."""
    return F.collate(text(c), "UNICODE")
