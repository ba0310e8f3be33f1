"""Rewriting texts by decisions, and proof that nothing forbidden is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def redacted(block_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks with every occurrence replaced by its placeholder.

    ``found`` has doc_id, block_order, start, end, placeholder.  Of overlapping
    occurrences the first, and of those the longest, is replaced.  The pieces
    between replacements are put together once, so offsets stay true.
    """
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "placeholder")))
    each = found.groupBy("doc_id", "block_order").agg(spans.alias("spans"))
    none = "array<struct<start:int,back:int,placeholder:string>>"
    rows = block_rows.join(each, ["doc_id", "block_order"], "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {none})")))
    # of each span whether it starts where nothing before it reaches: the furthest end so far decides
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {none})").alias("kept"))
    folded = F.aggregate("spans", start, lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(
        (-x["back"]).alias("at"), F.concat(s["kept"], F.array(x)).alias("kept"),
    )))
    rows = rows.withColumn("fold", folded).withColumn("kept", F.col("fold.kept"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(-F.get("kept", i - 1)["back"])
    pieces = F.transform("kept", lambda x, i: F.concat(F.substring("text", before(i) + 1, x["start"] - before(i)), x["placeholder"]))
    tail = F.substring("text", F.col("fold.at") + 1, F.length("text"))
    return rows.select("doc_id", "block_order", F.concat(F.array_join(pieces, ""), tail).alias("text"), F.size("spans").alias("n_found"))


def residue(rewritten: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``(doc_id, block_order, match)``: forbidden texts that a rewritten block of their document still holds."""
    met = rewritten.join(forbidden.select("doc_id", "match").distinct(), "doc_id")
    return met.filter(F.col("text").contains(F.col("match"))).select("doc_id", "block_order", "match")
