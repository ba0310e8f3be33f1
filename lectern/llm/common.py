"""Shared pieces of the corpus operators: tables, folds, shared-folder cuts, size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.shared import cleared, dropped, shared_dir, written  # noqa: F401  the operators take them from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Java regex of the separators between words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text with A-Z folded: the runs of characters outside SPACES."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


#: At most so many keys are split off by ``joined_by_weight`` and broadcast.
HOT_KEYS = 1_000


def joined_by_weight(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``found``, which has each key once and in ``weight`` the number of rows that have it.

    Keys that hold more than one in HOT_KEYS of all rows, which can't be more
    than HOT_KEYS, are broadcast and met where their rows are; the others are
    joined by shuffle.  Both frames should be tables, as they are read twice.
    """
    total = found.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(total // HOT_KEYS, 1)
    often, seldom = found.filter(hot).drop(weight), found.filter(~hot).drop(weight)
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(often), keys).unionByName(rest.join(seldom, keys))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if a count shows at most ``rows`` rows; else unmarked, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df
