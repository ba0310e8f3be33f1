"""Line deduplication over whole documents, in DataFrame functions only.

Explode normalised lines, hash them, count distinct documents per hash, drop
the lines over the threshold, and put the rest together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, joined_by_weight, written

EDGE = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z folded."""
    return ascii_lower(F.btrim(line, F.lit(EDGE)))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, mark, a, b, pos, first)``: the lines of at least ``min_chars`` code points.

    ``a`` and ``b`` are 128 bits of the line's key, ``mark`` those of its text,
    ``pos`` its place, and ``first`` marks one line of each key of a text.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    far = F.filter(lines, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.array_sort(F.transform(far, lambda x: F.struct(
        F.xxhash64(x["key"]).alias("a"), F.xxhash64(F.lit("second"), x["key"]).alias("b"), x["pos"].alias("pos"),
    )))
    each = docs.select("doc_id", F.xxhash64("text").alias("mark"), hashed.alias("h"))
    before = lambda i: F.get("h", i - 1)
    told = F.transform("h", lambda x, i: F.struct(
        x["a"].alias("a"), x["b"].alias("b"), x["pos"].alias("pos"),
        ((i == 0) | (before(i)["a"] != x["a"]) | (before(i)["b"] != x["b"])).alias("first"),
    ))
    return each.select("doc_id", "mark", F.explode(told).alias("x")).select("doc_id", "mark", "x.a", "x.b", "x.pos", "x.first")


def repeated_keys(lines: DataFrame, min_docs: int, repeated: bool) -> DataFrame:
    """``(a, b, keeper, rows)``: keys held by at least ``min_docs`` documents, the largest doc_id holding each, and the number of its lines."""
    by_key = lines.groupBy("a", "b").agg(F.count_if("first").alias("n"), F.max("doc_id").alias("keeper"), F.count("*").alias("rows"))
    if repeated:  # rows with one id are one document, those with null too
        ids = lines.select("a", "b", F.struct("doc_id").alias("id")).distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
        by_key = by_key.drop("n").join(ids, ["a", "b"])
    return by_key.filter(F.col("n") >= min_docs).select("a", "b", "keeper", "rows")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` and ``n_dropped`` added.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines, except in the document with the
    largest doc_id, which keeps all of its own.  A null text counts as empty:
    one empty line, never dropped.  Rows with the same doc_id are one
    document: they count once and are all the keeper or all not.  Rows whose
    doc_id is null form one document that keeps nothing another one holds.
    Other columns pass through whatever their names, but for columns named
    ``n_lines`` and ``n_dropped``, which are replaced; no rows give no rows.
    """
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    packed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"))
    lines, _ = written(long_lines(packed.select("doc_id", "text"), min_chars))
    ids = docs.select("doc_id")
    repeated = ids.count() != ids.distinct().count() or bool(ids.filter(F.col("doc_id").isNull()).limit(1).count())
    heavy, _ = written(repeated_keys(lines, min_docs, repeated))
    lost = (
        joined_by_weight(lines.select("doc_id", "mark", "a", "b", "pos"), heavy, ["a", "b"], "rows")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
        .withColumnRenamed("doc_id", "lost_id")
    )
    met = packed.join(lost, packed["doc_id"].eqNullSafe(lost["lost_id"]) & (F.xxhash64("text") == lost["mark"]), "left")
    split = met.select("own", "lost", F.split("text", "\n").alias("lines"))
    # what lies between the lost lines, piece by piece
    starts = F.concat(F.array(F.lit(0)), F.transform("lost", lambda x: x + 1))
    ends = F.concat(F.col("lost"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda x, y: F.slice(F.col("lines"), x + 1, y - x)))
    return split.select(
        *[F.col("own").getField(c).alias(c) for c in own], F.array_join(F.when(F.col("lost").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
