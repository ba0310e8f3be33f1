"""Normal forms of words and phrases for lookups; Unicode forms come from pandas functions, as Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """The letters without diacritics: NFD, and no combining marks."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def _straight(text: Column) -> Column:
    return F.translate(text, "‘’“”‐‑–—", "''\"\"----")


def entry(text: Column) -> Column:
    """An entry of a lexicon: compatible form, straight quotes, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(_straight(compatible(text)), r"\s+", " ")))


def name_tokens(text: Column) -> Column:
    """The words of a name in compatible form: letters with inner apostrophes, hyphens and dots."""
    return F.regexp_extract_all(compatible(text), F.lit(r"[\p{L}\p{M}]+(?:['’.-][\p{L}\p{M}]+)*"), F.lit(0))


def name_key(token: Column) -> Column:
    """A name for lookup: upper case letters A-Z without marks."""
    return F.regexp_replace(F.upper(without_marks(token)), "[^A-Z]", "")


def place_key(text: Column) -> Column:
    """A place for lookup: no marks, upper case, anything but letters and digits as one space, ``SAINT`` for ``ST``."""
    flat = F.trim(F.regexp_replace(F.upper(without_marks(text)), "[^A-Z0-9]+", " "))
    return F.regexp_replace(flat, r"\bST\b", "SAINT")


def phrase_key(text: Column, fold_and: bool = True, plural: bool = False) -> Column:
    """A term for lookup: straight, lower case, words by single spaces; ``&`` as ``and``; with ``plural``, no final s of a longer last word."""
    flat = F.lower(_straight(text))
    flat = F.replace(flat, F.lit("&"), F.lit(" and ")) if fold_and else flat
    flat = F.trim(F.regexp_replace(flat, r"[^\p{L}\p{N}']+", " "))
    return F.regexp_replace(flat, r"(?<=\p{L}{3})(?<!s)s$", "") if plural else flat


def full_value(text: Column) -> Column:
    """A whole value for comparison: lower case, no dots and commas, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[.,]", ""), r"\s+", " "))


def unclitic(token: Column) -> Column:
    """A word without a possessive or contracted ending."""
    return F.regexp_replace(token, r"(?i)['’](?:s|d|m|ll|re|ve)$", "")


def verb_forms(base: Column) -> Column:
    """A verb and its regular inflections."""
    e, y = base.endswith("e"), base.rlike("[^aeiou]y$")
    stem = F.when(e | y, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    third = F.when(y, F.concat(stem, F.lit("ies"))).when(base.rlike("(?:s|x|z|ch|sh)$"), F.concat(base, F.lit("es"))).otherwise(F.concat(base, F.lit("s")))
    past = F.when(y, F.concat(stem, F.lit("ied"))).otherwise(F.concat(stem, F.lit("ed")))
    going = F.when(y, F.concat(base, F.lit("ing"))).otherwise(F.concat(stem, F.lit("ing")))
    return F.array(base, third, past, going)


def collated(name: str, collation: str = "UNICODE") -> tuple[Column, Column]:
    """What to order by so that names stand as a language has them: by its collation, then by their bytes."""
    return F.collate(F.col(name), collation), F.col(name)
