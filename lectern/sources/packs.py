"""Packs of reference terms: delimited files, also inside archives, coded tables, word lists and overrides."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import forms


def read_delimited(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Rows of a file with a header, and ``(line, problem)`` of rejected ones; a missing column raises.

    Rows with too few or too many fields, or an empty required one, are
    rejected; files are read in parallel, so a row's text stands for its place.
    """
    head = spark.read.option("header", True).option("sep", sep).csv(path)
    lacking = [c for c in required if c not in head.columns]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    schema = ", ".join(f"`{c}` string" for c in head.columns) + ", broken string"
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").csv(path)
    empty = F.concat_ws(", ", *[F.when(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == "", c) for c in required])
    told = rows.withColumn("problem", F.when(F.col("broken").isNotNull(), "number of fields").when(empty != "", F.concat(F.lit("empty: "), empty)))
    line = F.coalesce("broken", F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in head.columns]))
    good = told.filter(F.col("problem").isNull()).select(*[F.col(f"`{c}`") for c in head.columns])
    return good, told.filter(F.col("problem").isNotNull()).select(line.alias("line"), "problem")


def read_archived(spark: SparkSession, path: str, sep: str = "|", renames: dict[str, str] | None = None) -> DataFrame:
    """``(member, number, fields)`` of every delimited file in archives; fields map the header's names, some of them renamed, to values.

    A byte order mark is dropped, and line ends of any kind count; members are
    read as streams, a line at a time.
    """
    renames = renames or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for member in sorted(archive.namelist()):
                        if member.endswith("/"):
                            continue
                        with archive.open(member) as stream:
                            names, rows = None, []
                            for number, line in enumerate(io.TextIOWrapper(stream, "utf-8-sig", newline=None)):
                                values = line.rstrip("\n").split(sep)
                                if names is None:
                                    names = [renames.get(x.strip(), x.strip()) for x in values]
                                elif line.strip():
                                    rows.append((member, number, dict(zip(names, values, strict=False))))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["member", "number", "fields"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["member", "number", "fields"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "member string, number long, fields map<string,string>")


def decoded(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with coded columns replaced by the values that their tables ``(code, value)`` give; a code without a value becomes null."""
    for column, values in tables.items():
        named = values.select(F.col("code").alias(f"{column} code"), F.col("value").alias(f"{column} value"))
        met = rows.join(named, rows[column] == named[f"{column} code"], "left")
        rows = met.drop(column, f"{column} code").withColumnRenamed(f"{column} value", column)
    return rows


def coded(rows: DataFrame, column: str) -> DataFrame:
    """The table ``(code, value)`` of a column's distinct values, numbered in their order; the inverse of ``decoded``."""
    from pyspark.sql import Window

    values = rows.select(F.col(column).alias("value")).filter(F.col(column).isNotNull()).distinct()
    # one window over the distinct values of a column that is worth coding
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def word_list(lines: DataFrame) -> DataFrame:
    """``(term)``: entries of ``lines(value)`` without comments after ``#``, in normal form, each once."""
    terms = lines.select(forms.entry(F.regexp_replace("value", "#.*$", "")).alias("term"))
    return terms.filter("term <> ''").distinct()


def overridden(packs: DataFrame, changes: DataFrame) -> DataFrame:
    """``packs(rule, term)`` with ``changes(rule, term, action)`` made: removed terms go, added ones come, each once."""
    kept = packs.join(changes.filter("action = 'remove'").select("rule", "term"), ["rule", "term"], "left_anti")
    return kept.select("rule", "term").unionByName(changes.filter("action = 'add'").select("rule", "term")).distinct()


def read_overrides(texts: DataFrame) -> DataFrame:
    """``(rule, term, action)`` of JSON texts ``value``: by rule, lists of terms to add and to remove."""
    parsed = texts.select(F.from_json("value", "map<string,struct<add:array<string>,remove:array<string>>>").alias("m"))
    each = parsed.select(F.explode("m").alias("rule", "lists"))
    return each.select("rule", F.explode("lists.add").alias("term"), F.lit("add").alias("action")).unionByName(
        each.select("rule", F.explode("lists.remove").alias("term"), F.lit("remove").alias("action"))
    )


def flags_by_key(rows: DataFrame, key: Column) -> DataFrame:
    """``(key, flags)``: the union of the bits of all rows ``(flag)`` of a key."""
    return rows.groupBy(key.alias("key")).agg(F.bit_or("flag").alias("flags"))


def has_bit(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def write_flags(flags: DataFrame, folder: str) -> None:
    """Keys in order with their flags as one text row each, in files that follow each other."""
    flags.repartitionByRange("key").sortWithinPartitions("key").select(F.concat_ws("\t", "key", "flags").alias("value")).write.text(folder)


def with_name_flags(values: DataFrame, names: DataFrame, first: int = 1, last: int = 2) -> DataFrame:
    """``values(value)`` with the flags of their first and last words in ``names(key, flags)``, and whether the two agree as a name."""
    tokens = F.split(F.trim("value"), r"\s+")
    words = values.withColumn("lead", forms.name_key(tokens[0])).withColumn("trail", forms.name_key(F.element_at(tokens, -1)))
    lead, trail = names.toDF("lead", "lead_flags"), names.toDF("trail", "trail_flags")
    met = words.join(lead, "lead", "left").join(trail, "trail", "left")
    return met.withColumn("name_like", (F.size(tokens) > 1) & has_bit(F.col("lead_flags"), first) & has_bit(F.col("trail_flags"), last))


def with_places(values: DataFrame, places: DataFrame) -> DataFrame:
    """``values(value, name_like)`` with what they are as places: only phrases of several words count, less so where they also look like a name."""
    keyed = values.withColumn("place_key", forms.place_key(F.col("value")))
    met = keyed.join(places.select(F.col("key").alias("place_key"), F.lit(True).alias("known")).distinct(), "place_key", "left")
    several = F.size(F.split("place_key", " ")) > 1
    return met.withColumn("place", F.when(F.col("known") & several, F.when(F.col("name_like"), "possible").otherwise("attested"))).drop("known")
