"""Normal forms of candidates: words that don't belong to a name come off, and what is left may be another candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import matches
from lectern.operators.detect import candidate_key

_EDGE = " .,'’"


def bare(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(_EDGE)))


def with_retained(rows: DataFrame, value: str, leading: tuple[str, ...], trailing: tuple[str, ...], pairs: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``rows`` with ``retained``: what is left of ``value`` when strippable words come off its ends, and then punctuation.

    ``leading`` and ``trailing`` are words that come off; ``pairs`` are two
    words that come off a head together.  A value of such words alone stays
    whole; one without a letter or digit has nothing left, which is null.
    """
    heads, tails, doubles = (
        F.array(*[F.lit(x) for x in words]) if words else F.expr("cast(array() as array<string>)") for words in (leading, trailing, [" ".join(p) for p in pairs])
    )
    # step by step, so that no expression holds another one many times
    steps = rows.select("*", matches(F.col(value), r"\S+").alias("_tokens"))
    steps = steps.select("*", F.transform("_tokens", lambda t: bare(t["text"])).alias("_names"))
    names, n = F.col("_names"), F.size("_names")

    def head(s: Column, i: Column) -> Column:
        one = F.array_contains(heads, F.get(names, i))
        two = F.array_contains(doubles, F.concat_ws(" ", F.get(names, i), F.get(names, i + 1))) & (i + 1 < n)
        return F.when(s["open"] & (s["at"] == i), F.struct((i + F.when(one, 1).when(two, 2).otherwise(0)).cast("int").alias("at"), (one | two).alias("open"))).otherwise(s)

    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    first = F.aggregate(at, F.struct(F.lit(0).alias("at"), F.lit(True).alias("open")), head, lambda s: s["at"])
    kept_tail = F.array_position(F.reverse(F.transform(names, lambda x: ~F.array_contains(tails, x))), F.lit(True)).cast("int")
    steps = steps.select("*", first.alias("_first"), F.when(kept_tail == 0, F.lit(0)).otherwise(n - kept_tail + 1).alias("_last"))
    whole = F.col("_first") >= F.col("_last")
    lo = F.get("_tokens", F.when(whole, F.lit(0)).otherwise(F.col("_first")))["start"]
    hi = F.get("_tokens", F.when(whole, n - 1).otherwise(F.col("_last") - 1))["end"]
    steps = steps.select("*", lo.alias("_lo"), hi.alias("_hi"))
    left = F.btrim(F.substring(value, F.col("_lo") + 1, F.col("_hi") - F.col("_lo")), F.lit(_EDGE))
    return steps.withColumn("retained", F.nullif(left, F.lit(""))).drop("_tokens", "_names", "_first", "_last", "_lo", "_hi")


def merges(candidates: DataFrame, named: Column, leading: tuple[str, ...], trailing: tuple[str, ...], pairs: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``(doc_id, candidate_key, target_key, retained)``: people whose retained text is the value of another person of their document.

    ``candidates``: doc_id, candidate_key, detected_type, display_value, and
    what ``named`` looks at; it must hold for the target.  A merge into one
    that is itself merged is dropped, so that nothing is passed on.
    """
    people = with_retained(candidates.filter("detected_type = 'person'").select("doc_id", "candidate_key", "display_value"), "display_value", leading, trailing, pairs)
    # an array of one, exploded: filters on the result aren't pushed into the steps above, where each would repeat them
    people = people.select("doc_id", "candidate_key", "display_value", F.explode(F.array("retained")).alias("retained"))
    changed = people.filter("retained <> display_value").withColumn("target_key", candidate_key(F.lit("person"), F.col("retained"))).filter("target_key <> candidate_key")
    targets = candidates.filter(named).select("doc_id", F.col("candidate_key").alias("target_key"))
    planned = changed.join(targets, ["doc_id", "target_key"], "left_semi")
    away = planned.select("doc_id", F.col("candidate_key").alias("target_key"))
    return planned.join(away, ["doc_id", "target_key"], "left_anti").select("doc_id", "candidate_key", "target_key", "retained")


def rehomed(found: DataFrame, planned: DataFrame) -> DataFrame:
    """Occurrences under their targets, narrowed to the retained text where the match holds it; ``moved`` and ``narrowed`` tell."""
    met = found.join(planned, ["doc_id", "candidate_key"], "left")
    at = F.expr("locate(retained, match)")
    moved = F.col("target_key").isNotNull()
    narrowed = moved & (at > 0)
    return met.select(
        "doc_id", F.coalesce("target_key", "candidate_key").alias("candidate_key"), "block_order",
        F.when(narrowed, F.col("start") + at - 1).otherwise(F.col("start")).alias("start"),
        F.when(narrowed, F.col("start") + at - 1 + F.length("retained")).otherwise(F.col("end")).alias("end"), moved.alias("moved"), narrowed.alias("narrowed"),
    )


def statistics(rows: DataFrame, *keys: str) -> DataFrame:
    """Occurrences that were moved, narrowed, or moved whole."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("moved").alias("n_moved"), F.count_if("narrowed").alias("n_narrowed"),
        F.count_if(F.col("moved") & ~F.col("narrowed")).alias("n_whole"),
    )
