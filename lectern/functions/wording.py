"""Expressions for wording: sets, phrases, placeholders, replacements, references, figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders of the types; others are built from the type's name.
PLACEHOLDERS = {
    "email": "[REDACTED EMAIL]",
    "phone": "[REDACTED PHONE]",
    "cin": "[REDACTED ID]",
    "long_numeric_id": "[REDACTED ID]",
    "person": "[PERSON REDACTED]",
}
#: Mode, blanket text and pattern of the types.
RULES = {
    "person": ("sequential", "[REDACTED NAME]", "PERSON_{n}"),
    "email": ("blanket", "[REDACTED EMAIL]", "EMAIL_{n}"),
    "phone": ("blanket", "[REDACTED PHONE]", "PHONE_{n}"),
    "cin": ("blanket", "[REDACTED ID]", "ID_{n}"),
    "long_numeric_id": ("blanket", "[REDACTED ID]", "ID_{n}"),
    "organization": ("blanket", "[REDACTED ORGANIZATION]", "ORG_{n}"),
    "other_identifier": ("blanket", "[REDACTED]", "IDENTIFIER_{n}"),
}


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct members; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def joined(phrases: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(phrases)
    last = F.get(phrases, n - 1)
    return (
        F.when(n == 0, "").when(n == 1, phrases[0]).when(n == 2, F.concat_ws(" and ", phrases))
        .otherwise(F.concat(F.array_join(F.slice(phrases, F.lit(1), n - 1), ", "), F.lit(", and "), last))
    )


def title_case(text: Column) -> Column:
    """Underscores and hyphens as spaces, each word with a capital."""
    return F.initcap(F.regexp_replace(text, "[_-]+", " "))


def placeholder(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    return F.coalesce(F.element_at(known, kind), F.concat(F.lit("[REDACTED "), F.upper(kind), F.lit("]")))


def padded(n: Column) -> Column:
    """At least three digits."""
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))


def numbered_placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit(" "), padded(n), F.lit("]"))


def from_template(template: Column, n: Column) -> Column:
    """``{n}`` as the padded number, 1 where there is none."""
    return F.replace(template, F.lit("{n}"), padded(F.coalesce(n, F.lit(1))))


def rule(kind: Column, mode: Column, blanket: Column, pattern: Column) -> Column:
    """The rule of a type as ``(mode, blanket, pattern)``: given parts over defaults, unknown modes as blanket, a pattern always numbered."""
    name = F.coalesce(F.nullif(F.lower(F.trim(kind)), F.lit("")), F.lit("other_identifier"))
    filled = lambda x: F.nullif(x, F.lit(""))
    part = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[i])]), name)
    chosen = F.lower(F.coalesce(filled(mode), part(0), F.lit("blanket")))
    text = F.coalesce(filled(pattern), part(2), F.concat(F.upper(F.replace(name, F.lit("-"), F.lit("_"))), F.lit("_{n}")))
    return F.struct(
        F.when(chosen.isin("blanket", "sequential"), chosen).otherwise("blanket").alias("mode"),
        F.coalesce(filled(blanket), part(1), F.concat(F.lit("[REDACTED "), F.upper(F.replace(name, F.lit("_"), F.lit(" "))), F.lit("]"))).alias("blanket"),
        F.when(F.contains(text, F.lit("{n}")), text).otherwise(F.concat(text, F.lit("_{n}"))).alias("pattern"),
    )


def with_replacements(text: Column, rules: Column) -> Column:
    """``text`` with each ``(original, replacement)`` of an array put in, whole words in any case, longest originals first."""
    ordered = F.array_sort(rules, lambda a, b: F.length(b["original"]) - F.length(a["original"]))
    quoted = lambda x: F.concat(F.lit(r"(?iU)(?<!\w)\Q"), x, F.lit(r"\E(?!\w)"))
    plain = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    return F.aggregate(ordered, text, lambda s, r: F.regexp_replace(s, quoted(r["original"]), plain(r["replacement"])))


def paragraph_ref(part: Column, index: Column) -> Column:
    return F.concat_ws(" ", F.lit("paragraph"), part, index.cast("string"))


def read_ref(ref: Column) -> Column:
    """``(kind, part, index, relation)`` of a reference; null for an unknown kind."""
    bits = F.split(ref, " ")
    kind = bits[0]
    return F.when(kind.isin("paragraph", "tracked-deletion", "hyperlink"), F.struct(
        kind.alias("kind"), F.get(bits, F.lit(1)).alias("part"),
        F.when(kind != "hyperlink", F.get(bits, F.lit(2)).cast("int")).alias("index"), F.when(kind == "hyperlink", F.get(bits, F.lit(2))).alias("relation"),
    ))


def percent_shown(value: Column, decimals: int = 0) -> Column:
    """A percentage, kept inside 0 to 100; ``~`` before one that only rounding makes 0 or 100; no figure is ``0%``."""
    whole = F.least(F.lit(100.0), F.greatest(F.lit(0.0), value.cast("double")))
    figure = F.round(whole, decimals)
    near = ((figure == 0) & (whole > 0)) | ((figure == 100) & (whole < 100))
    return F.when(value.isNull() | F.isnan(value.cast("double")), "0%").otherwise(F.concat(F.when(near, "~").otherwise(""), F.format_number(figure, decimals), F.lit("%")))


def parts_of(n_tokens: Column, cuts: Column) -> Column:
    """Sizes in tokens of the parts that cuts after the given tokens make; cuts outside of the tokens don't count."""
    good = F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c >= 0) & (c <= n_tokens - 2))))
    ends = F.concat(good, F.array(n_tokens - 1))
    starts = F.concat(F.array(F.lit(-1)), good)
    return F.when(n_tokens <= 0, F.expr("cast(array() as array<int>)")).otherwise(F.zip_with(starts, ends, lambda a, b: (b - a).cast("int")))


def hidden_inside(text: Column) -> Column:
    """Whether an invisible format character stands between two letters."""
    return text.rlike(r"(?<=\p{L})\p{Cf}(?=\p{L})")


def blank_image(raw: Column) -> Column:
    """Whether the header of a PNG or GIF says that it has at most one pixel."""
    number = lambda at, n: F.conv(F.hex(F.substring(raw, at, n)), 16, 10).cast("long")
    little = lambda at: number(at, 1) + number(at + 1, 1) * 256
    png = F.hex(F.substring(raw, 1, 8)) == "89504E470D0A1A0A"
    gif = F.hex(F.substring(raw, 1, 3)) == "474946"
    return F.when(png, (number(17, 4) <= 1) & (number(21, 4) <= 1)).when(gif, (little(7) <= 1) & (little(9) <= 1)).otherwise(False)
