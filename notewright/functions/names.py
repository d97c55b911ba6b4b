"""Cleaning of scraped names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright.constants import BRACKETED_PART, NAME_SEPARATORS, NUMBER_AFTER_DOT


def clean_name(name: Column) -> Column:
    """Name without separators, bracketed parts and numbers after dots, with a space before every capital but a leading one."""
    kept = F.translate(name, NAME_SEPARATORS, "")
    for part in (BRACKETED_PART, NUMBER_AFTER_DOT):
        kept = F.regexp_replace(kept, part, "")
    rest = F.regexp_replace(F.substr(kept, F.lit(2)), "[A-Z]", " $0")
    return F.concat(F.left(kept, F.lit(1)), rest)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def first_artist(title_artist: Column) -> Column:
    entry = F.get(title_artist, 0)
    return F.when(F.size(entry) >= 2, F.get(entry, 1)).otherwise(F.get(entry, 0))


def first_title(title_artist: Column) -> Column:
    entry = F.get(title_artist, 0)
    return F.when(F.size(entry) >= 2, F.get(entry, 0)).otherwise("unknown")


def stringified_list(text: Column) -> Column:
    """Inner list of a printed ``[['a', 'b']]``."""
    return F.get(F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<array<string>>"), 0)
