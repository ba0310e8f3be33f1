"""Text expressions shared by the operators: matches with offsets, boundaries, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "A-Za-z0-9_"
#: A word boundary that knows ASCII letters only, as Java's own also counts accented ones.
ASCII_B = rf"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"

def starting(first: str) -> str:
    """A character of the ASCII class ``first`` at the start of a word, looked for before what stands in front of it."""
    return rf"{first}(?<![{_W}]{first})"


#: All space separators of Unicode (category Zs), which DuckDB's trim takes off; Spark's own knows the first alone.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Not next to a letter or digit; identifiers inside longer tokens don't count.
ID_START, ID_END = r"(?<![\p{L}\d])", r"(?![\p{L}\d])"
#: Not next to any character of a word.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}\p{M}_])", r"(?![\p{L}\p{N}\p{M}_])"


#: Offsets are gathered in pieces of this size, so that appending to an array stays cheap.
_PIECE = 256


def matches(text: Column, pattern: str) -> Column:
    """All matches with offsets in code points: an array of ``(start, end, text)``.

    One pass keeps the running offset, so the cost grows with the text.  The
    pattern is sought once, and once more for the offsets where it was found.
    """
    # an element of an array is a variable, which is not evaluated anew wherever it is used
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda found: _placed(text, pattern, found)), F.lit(0))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """``matches`` of the texts that were found."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    # the last gap is what follows all matches
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"), m.alias("text")))
    kind = "array<struct<start:int,end:int,text:string>>"
    empty = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(array() as {kind})").alias("open"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["own"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text")))
        full = F.size(s["open"]) >= _PIECE
        return F.struct(
            end.alias("at"), F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full, one).otherwise(F.concat(s["open"], one)).alias("open"),
        )

    placed = F.aggregate(steps, empty, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.size(found) == 0, F.expr(f"cast(array() as {kind})")).otherwise(placed)


def snippet(text: Column, start: Column, end: Column, reach: int = 70) -> Column:
    """``...left[match]right...`` with ``reach`` characters on either side."""
    lo = F.greatest(start - reach, F.lit(0))
    left = F.substring(text, lo + 1, start - lo)
    right = F.substring(text, end + 1, F.lit(reach))
    return F.concat(
        F.when(lo > 0, "...").otherwise(""), left, F.lit("["), F.substring(text, start + 1, end - start), F.lit("]"), right,
        F.when(end + reach < F.length(text), "...").otherwise(""),
    )


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def shape(text: Column) -> Column:
    """Digits as ``#``, ASCII letters as ``A``."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "#"), "[A-Za-z]", "A")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
