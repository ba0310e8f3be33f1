"""Detection of sensitive entities in blocks of text, with exact offsets."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ASCII_B, ID_END, ID_START, WORD_END, WORD_START, digits, matches, snippet, squeeze
from lectern.sources.shared import written

_UP, _LOW, _NAME = r"\p{Lu}", r"[\p{Ll}\p{M}]", r"[\p{L}\p{M}'’-]"
EMAIL = rf"(?i){ASCII_B}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{ASCII_B}"
PHONE = rf"{ID_START}(?:\+?1[\s.-]?)?(?:\(?\d{{3}}\)?[\s.-]?)\d{{3}}[\s.-]?\d{{4}}{ID_END}"
NINE_DIGITS = rf"{ID_START}\d{{9}}{ID_END}"
LONG_ID = rf"{ID_START}\d(?:[\s-]?\d){{9,18}}{ID_END}"
#: The capital is looked for first, as it fails sooner than what must not stand before it.
_CAPITAL = rf"(?={_UP}){WORD_START}"
LAST_FIRST = rf"{_CAPITAL}{_UP}{_NAME}{{1,30}},\s+{_UP}{_NAME}{{1,30}}(?:\s+{_UP}{_NAME}{{1,30}})?{WORD_END}"
SEQUENCE = rf"{_CAPITAL}(?:{_UP}{_LOW}{{1,30}})(?:\s+(?:{_UP}{_LOW}{{1,30}})){{1,5}}{WORD_END}"
SINGLE = rf"{_CAPITAL}{_UP}{_NAME}{{2,30}}{WORD_END}"
DATE_LIKE = r"^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})$"
#: Phrases that look like names and are not.
STOP_PHRASES = ("Microsoft Teams", "Teams Meeting", "From Sent", "Subject Re", "Page Number", "Table Of")
#: Single capitalised words that are not names.
SINGLE_STOP_WORDS = tuple(
    "Account Attachment Body Call Category CIN Core DOCX Date Email Footer From Header ID January February March April May June July August "
    "September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Meeting Message Microsoft Page Participant "
    "Phone Re Sent Subject Table Teams Word".split()
)
#: (type, pattern, confidence, rank); the rank is the order in which the first one sets a candidate's attributes.
DETECTORS = (
    ("email", EMAIL, "high", 0), ("phone", PHONE, "medium", 1), ("cin", NINE_DIGITS, "high", 2),
    ("long_numeric_id", LONG_ID, "medium", 3), ("person", LAST_FIRST, "low", 4), ("person", SEQUENCE, "low", 5),
)


def blocks(docs: DataFrame) -> DataFrame:
    """``(doc_id, block_order, text)``: the non-empty lines of every document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_order", "text"))
    return lines.filter(F.trim("text") != "")


def candidate_key(kind: Column, text: Column) -> Column:
    """``type:normal form``: digits of numbers, folded text of the others."""
    numbers = kind.isin(*_NUMBERS)
    return F.concat(kind, F.lit(":"), F.when(numbers, digits(text)).otherwise(F.lower(squeeze(text))))


def _kept(kind: Column, text: Column, block: Column, start: Column, end: Column) -> Column:
    """Whether a match survives the filters of its type."""
    around = F.lower(F.substring(block, F.greatest(start - 15, F.lit(0)) + 1, end - start + 30))
    number = ~F.trim(text).rlike(DATE_LIKE) & ~((F.length(digits(text)) <= 4) & around.contains("page"))
    person = ~text.isin(*STOP_PHRASES)  # the name patterns have no room for an address
    return F.when(kind == "phone", number).when(kind == "long_numeric_id", number & (F.length(digits(text)) >= 10)).when(kind == "person", person).otherwise(True)


#: Types whose matches are made of digits.
_NUMBERS = ("phone", "cin", "long_numeric_id")


def occurrences(block_rows: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Every match of every detector, or of those of ``kinds``: one pass over the blocks, one array of matches for each."""
    # cheap tests spare most blocks the patterns that can't match them; numbers share theirs
    likely = {EMAIL: F.col("text").contains("@"), LAST_FIRST: F.col("text").contains(",")}
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")

    def told(kind: str, pattern: str, confidence: str, rank: int) -> Column:
        found = matches(F.col("text"), pattern)
        return F.transform(F.when(likely[pattern], found).otherwise(none) if pattern in likely else found, lambda m: F.named_struct(
            F.lit("detected_type"), F.lit(kind), F.lit("confidence"), F.lit(confidence), F.lit("rank"), F.lit(rank),
            F.lit("start"), m["start"], F.lit("end"), m["end"], F.lit("match"), m["text"],
        ))

    wanted = [d for d in DETECTORS if kinds is None or d[0] in kinds]
    numbers, others = ([told(*d) for d in wanted if (d[0] in _NUMBERS) == n] for n in (True, False))
    if numbers:
        shape = "array<struct<detected_type:string,confidence:string,rank:int,start:int,end:int,match:string>>"
        several = F.col("text").rlike("[0-9][^A-Za-z]*[0-9][^A-Za-z]*[0-9]")
        others.append(F.when(several, F.flatten(F.array(*numbers))).otherwise(F.expr(f"cast(array() as {shape})")))
    found = F.flatten(F.array(*others))
    rows = block_rows.select("doc_id", "block_order", "text", F.explode(found).alias("m"))
    good = rows.filter(_kept(F.col("m.detected_type"), F.col("m.match"), F.col("text"), F.col("m.start"), F.col("m.end")))
    return good.select(
        "doc_id", "block_order", candidate_key(F.col("m.detected_type"), F.col("m.match")).alias("candidate_key"), "m.detected_type",
        "m.confidence", "m.rank", "m.start", "m.end", F.col("m.match").alias("match"),
        snippet(F.col("text"), F.col("m.start"), F.col("m.end")).alias("context"),
    )


def candidates(found: DataFrame) -> DataFrame:
    """One row per document and key: the first occurrence's attributes, and the number of occurrences."""
    order = F.struct("rank", "block_order", "start")
    return found.groupBy("doc_id", "candidate_key").agg(
        F.min_by("detected_type", order).alias("detected_type"), F.min_by("confidence", order).alias("confidence"),
        F.min_by("match", order).alias("display_value"), F.count("*").alias("n_occurrences"),
    )


#: A neighbour: a comma, two spaces, at most 31 letters and what ends them.
_BESIDE = 36


def single_names(block_rows: DataFrame, least: int = 2) -> DataFrame:
    """Single capitalised names without a capitalised neighbour that a document has at least ``least`` times."""
    # only what stands next to a match is looked at; with single spaces that has a greatest length
    flat = block_rows.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    rows = flat.select("doc_id", "text", F.explode(matches(F.col("text"), SINGLE)).alias("m"))
    before = F.substring("text", F.greatest(F.col("m.start") - _BESIDE, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(_BESIDE)))
    after = F.substring("text", F.col("m.end") + 1, F.lit(_BESIDE))
    alone = ~before.rlike(rf"{_UP}{_NAME}{{1,30}},?\s*$") & ~after.rlike(rf"^\s*,?\s*{_UP}{_NAME}{{1,30}}{WORD_END}")
    named = rows.filter(alone & ~F.col("m.text").isin(*SINGLE_STOP_WORDS)).select("doc_id", F.lower("m.text").alias("name"))
    return named.groupBy("doc_id", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def numbered(found: DataFrame) -> DataFrame:
    """Occurrences with their ordinal inside the candidate, and a placeholder numbered per type in order of first occurrence.

    They are written to the shared folder, as they are read for both numbers.
    """
    found, _ = written(found)
    order = F.struct("block_order", "start", "rank")
    one = Window.partitionBy("doc_id", "candidate_key").orderBy("block_order", "start", "rank")
    firsts = found.groupBy("doc_id", "detected_type", "candidate_key").agg(F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "detected_type").orderBy("first", "candidate_key"))
    names = firsts.withColumn("placeholder", F.format_string("[%s %03d]", F.upper("detected_type"), rank)).select("doc_id", "candidate_key", "placeholder")
    return found.withColumn("ordinal", F.row_number().over(one)).join(names, ["doc_id", "candidate_key"])


def single_occurrences(block_rows: DataFrame, least: int = 2) -> DataFrame:
    """Occurrences of the single names that a document has at least ``least`` times, in the form of ``occurrences``.

    Each stands by itself in its block: no capitalised neighbour.  They are
    people of low confidence whose attributes give way to any other detector's.
    """
    rows = block_rows.select("doc_id", "block_order", "text", F.explode(matches(F.col("text"), SINGLE)).alias("m"))
    # white space beside a match may be of any length, so what stands there is squeezed before it is looked at
    squeezed = lambda side: F.regexp_replace(side, r"\s+", " ")
    before = squeezed(F.substring("text", F.greatest(F.col("m.start") - _FAR, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(_FAR))))
    after = squeezed(F.substring("text", F.col("m.end") + 1, F.lit(_FAR)))
    alone = ~before.rlike(rf"{_UP}{_NAME}{{1,30}},?\s*$") & ~after.rlike(rf"^\s*,?\s*{_UP}{_NAME}{{1,30}}{WORD_END}")
    found = rows.filter(alone & ~F.col("m.text").isin(*SINGLE_STOP_WORDS)).select(
        "doc_id", "block_order", candidate_key(F.lit("person"), F.col("m.text")).alias("candidate_key"), F.lit("person").alias("detected_type"), F.lit("low").alias("confidence"), F.lit(6).alias("rank"),
        F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("match"), snippet(F.col("text"), F.col("m.start"), F.col("m.end")).alias("context"),
    )
    often = found.groupBy("doc_id", "candidate_key").agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")
    return found.join(often, ["doc_id", "candidate_key"], "left_semi").select(found.columns)


#: White space between a match and its neighbour is followed so far, which bounds the work for each match.
_FAR = 400


def all_occurrences(block_rows: DataFrame, least: int = 2) -> DataFrame:
    """The stream of all detectors, single names included; ``candidates`` and ``numbered`` take it as they take ``occurrences``."""
    return occurrences(block_rows).unionByName(single_occurrences(block_rows, least))
