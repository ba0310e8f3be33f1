"""Queries over readings of candidates, identities, splits and anchors; parts stand for candidates, brands for documents."""

from pyspark.sql import functions as F

from lectern.operators import context, interpret
from lectern.operators.detect import EMAIL
from lectern.plans.catalog import query


def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size")


def _list(values):
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _texts(values):
    return F.array(*[F.lit(x) for x in values])


_RULES = ("contraction", "common_english_word", "known_surname", "organization_suffix", "all_caps")


@query(f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'neutral' WHEN 1 THEN 'negative' WHEN 3 THEN 'neutral'
  ELSE CASE sign(p_size - 25) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END END AS polarity FROM part
""")
def rule_polarity(spark, sf_dir):
    rule = F.get(_texts(_RULES), (F.col("p_partkey") % 5).cast("int"))
    return _parts(spark, sf_dir).select("p_partkey", interpret.polarity(rule, F.col("p_size") - 25).alias("polarity"))


_SIGNALS = ("person/census-token-membership", "person/census-token-membership", "person/census-name-structure", "person/nearby-title", "person/entity-linkage")
_OTHERS = ("place", "organization", "domain-terminology")

_READ = f"""
read AS (SELECT p_partkey, p_brand, p_size, p_size % 4 + 1 AS n_tokens, list_transform(range(p_size % 3), lambda i: ({_list(_SIGNALS)})[(p_partkey + i * i) % 5 + 1]) AS signals,
  list_transform(range(p_size % 3), lambda i: (p_partkey + i) // 2 % 3) AS sources, ({_list(_OTHERS)})[1 : greatest(p_size % 5 - 1, 0)] AS others FROM part)
"""


def _read(spark, sf_dir):
    size, key, n = F.col("p_size"), F.col("p_partkey"), F.col("p_size") % 3
    signals = F.array(*[F.get(_texts(_SIGNALS), ((key + i * i) % 5).cast("int")) for i in range(2)])
    sources = F.array(*[F.array(F.floor((key + i) / 2 % 3).cast("string")) for i in range(2)])
    return _parts(spark, sf_dir).select(
        "p_partkey", "p_brand", (size % 4 + 1).alias("n_tokens"), F.slice(signals, F.lit(1), n).alias("signals"), F.slice(sources, F.lit(1), n).alias("lineages"),
        F.slice(_texts(_OTHERS), F.lit(1), F.greatest(size % 5 - 1, F.lit(0))).alias("alternatives"),
    )


@query("WITH " + _READ + """,
judged AS (SELECT *, len(signals) > 0 AS had_reading, len(signals) > 0 AND (n_tokens = 1 OR len(list_filter(signals, lambda s: s <> 'person/census-token-membership')) > 0) AS supported FROM read)
SELECT p_partkey, had_reading, supported, array_to_string(list_filter([
    CASE WHEN list_contains(signals, 'person/census-name-structure') OR (n_tokens = 1 AND list_contains(signals, 'person/census-token-membership')) THEN 'candidate-span' END,
    CASE WHEN n_tokens > 1 AND list_contains(signals, 'person/census-token-membership') THEN 'component' END,
    CASE WHEN list_contains(signals, 'person/nearby-title') THEN 'neighbourhood' END, CASE WHEN list_contains(signals, 'person/entity-linkage') THEN 'inherited' END
  ], lambda x: x IS NOT NULL), ',') AS scopes, len(list_distinct(sources))::INT AS n_witnesses,
  CASE WHEN supported THEN 'person-survives' WHEN len(others) = 1 THEN 'reclassify' WHEN len(others) > 1 THEN 'contested-without-person' ELSE 'undetermined' END AS disposition,
  CASE WHEN NOT supported AND len(others) = 1 THEN others[1] END AS becomes FROM judged
""")
def person_adjudication(spark, sf_dir):
    """Whether the reading as a person stands, what it rests on, and what else a candidate may be."""
    return interpret.adjudicated(_read(spark, sf_dir)).select(
        "p_partkey", "had_reading", "supported", F.array_join("scopes", ",").alias("scopes"), "n_witnesses", "disposition", "becomes"
    )


@query("WITH " + _READ + """,
r AS (SELECT CASE WHEN len(signals) > 0 THEN list_concat(['person'], others) ELSE others END AS readings FROM read)
SELECT CASE len(readings) WHEN 0 THEN 'unsupported' WHEN 1 THEN 'single' ELSE 'contested' END AS outcome, array_to_string(readings, '+') AS contest, count(*) AS n FROM r GROUP BY ALL
""")
def reading_outcomes(spark, sf_dir):
    readings = F.when(F.size("signals") > 0, F.concat(_texts(("person",)), F.col("alternatives"))).otherwise(F.col("alternatives"))
    rows = _read(spark, sf_dir).select(readings.alias("r"))
    return rows.groupBy(interpret.outcome(F.col("r")).alias("outcome"), interpret.contest(F.col("r")).alias("contest")).agg(F.count("*").alias("n"))


_KINDS = ("person", "email", "organization")
_USED = ("anchor_signature_block", "possessive")


@query(f"""
WITH f AS (SELECT p_partkey, p_brand, p_size, ({_list(_KINDS)})[p_partkey % 3 + 1] AS kind FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 4 = 0 THEN 'known-surname' END, CASE WHEN p_size % 5 = 0 THEN 'nearby-title' END,
  CASE p_size % 3 WHEN 0 THEN 'anchor:signature_block' WHEN 1 THEN 'contextual-usage:possessive' END,
  CASE WHEN p_size % 7 = 0 THEN 'person-evidenced-linkage' END, CASE WHEN p_size % 11 = 0 THEN 'census-name-structure' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM f WHERE kind <> 'email'
""")
def person_protection(spark, sf_dir):
    """Reasons that protect candidates of undecided types as people."""
    size = F.col("p_size")
    used = F.array_compact(F.array(F.get(_texts(_USED), (size % 3).cast("int"))))
    categories, positives = (F.when(size % k == 0, _texts((x,))) for k, x in ((4, "known_surname"), (5, "nearby_title")))
    rows = _parts(spark, sf_dir).withColumn("detected_type", F.get(_texts(_KINDS), (F.col("p_partkey") % 3).cast("int")))
    reasons = interpret.person_reasons(categories, positives, used, size % 7 == 0, size % 11 == 0)
    return interpret.undecided_types(rows).select("p_partkey", F.array_join(reasons, ",").alias("reasons"))


# --- identities ---------------------------------------------------------------------------------

_ORDINARY, _NAMES, _AMBIGUOUS = ("old", "new", "rod", "hot"), ("rod",), ("hot",)
_LEXICON = [(w, k) for k, words in (("ordinary", _ORDINARY), ("name", _NAMES), ("ambiguous", _AMBIGUOUS)) for w in words]

_OPTIONS = """
o AS (SELECT p_brand AS candidate_key, p_partkey AS position, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[1] || ' old ' || string_split(p_name, ' ')[2] ELSE 'new ' || p_name END AS name,
  p_size % 10 = 0 AS backed, p_brand < 'Brand#2' AS relabel FROM part),
t AS (SELECT *, string_split(name, ' ') AS words FROM o), k AS (SELECT *, list_filter(words, lambda w: w NOT IN ('old', 'new')) AS kept FROM t),
good AS (SELECT *, len(kept) = len(words) AS clean, CASE WHEN relabel THEN array_to_string(kept, ' ') ELSE name END AS cleaned FROM k WHERE NOT backed AND len(kept) >= 2 AND words[1] NOT IN ('old', 'new')),
one AS (SELECT *, row_number() OVER (PARTITION BY candidate_key, CASE WHEN relabel THEN array_to_string(kept, ' ') ELSE name END ORDER BY CASE WHEN clean THEN 0 ELSE 1 END, position) AS i FROM good)
"""


def _options(spark, sf_dir):
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(first, F.lit(" old "), last)).otherwise(F.concat(F.lit("new "), "p_name"))
    return _parts(spark, sf_dir).select(
        F.col("p_brand").alias("candidate_key"), F.col("p_partkey").alias("position"), name.alias("name"), (F.col("p_size") % 10 == 0).alias("backed"), (F.col("p_brand") < "Brand#2").alias("relabel")
    )


def _lexicon(spark):
    return spark.createDataFrame(_LEXICON, "word string, kind string")


@query("WITH " + _OPTIONS + "SELECT candidate_key, position, name, cleaned FROM one WHERE i = 1 UNION ALL SELECT candidate_key, position, name, name FROM o WHERE backed")
def identity_options(spark, sf_dir):
    """Identities that candidates may have, without ordinary words and without repeats."""
    return interpret.cleaned_options(_options(spark, sf_dir), _lexicon(spark))


@query("WITH " + _OPTIONS + """,
p AS (SELECT count(DISTINCT candidate_key) AS proposals_before, count(*) AS options_before FROM o),
a AS (SELECT candidate_key FROM one WHERE i = 1 UNION ALL SELECT candidate_key FROM o WHERE backed)
SELECT proposals_before, options_before, count(DISTINCT candidate_key) AS proposals_after, count(*) AS options_after FROM a, p GROUP BY ALL
""")
def identity_statistics(spark, sf_dir):
    """Candidates and their possible identities before and after cleaning."""
    options = _options(spark, sf_dir)
    tagged = options.select("candidate_key", F.lit(True).alias("before")).unionByName(interpret.cleaned_options(options, _lexicon(spark)).select("candidate_key", F.lit(False).alias("before")))
    each = tagged.groupBy("candidate_key").agg(F.count_if("before").alias("b"), F.count_if(~F.col("before")).alias("a"))
    return each.agg(
        F.count_if(F.col("b") > 0).alias("proposals_before"), F.sum("b").alias("options_before"), F.count_if(F.col("a") > 0).alias("proposals_after"), F.sum("a").alias("options_after")
    )


@query("""
WITH g AS (SELECT p_partkey AS group_id, string_split(p_name, ' ')[1] || ' old ' || string_split(p_name, ' ')[2] AS name, p_name AS cleaned FROM part)
SELECT * FROM g WHERE string_split(cleaned, ' ')[1] NOT IN ('old', 'new') AND group_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
""")
def inserted_words(spark, sf_dir):
    """Groups named with an ordinary word inside, at which a known name points."""
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    groups = _parts(spark, sf_dir).select(F.col("p_partkey").alias("group_id"), F.concat(first, F.lit(" old "), last).alias("name"))
    grounded = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 45").select(F.col("l_partkey").alias("group_id"))
    return interpret.inserted_words(groups, grounded, _lexicon(spark))


# --- splits and anchors -------------------------------------------------------------------------

_PARTED = "CASE p_size % 5 WHEN 0 THEN ', ' WHEN 1 THEN ' and ' WHEN 2 THEN ' ' WHEN 3 THEN ' & ' ELSE ', or ' END"


@query(f"""
WITH w AS (SELECT p_partkey, p_size % 5 AS c, {_PARTED} AS sep, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, w[1] || sep || w[2] || ' x' AS value, CASE WHEN c = 2 THEN '' ELSE '0' END AS boundaries,
  CASE c WHEN 2 THEN '' WHEN 1 THEN 'coordinating-conjunction' WHEN 4 THEN 'dividing-punctuation,coordinating-conjunction' ELSE 'dividing-punctuation' END ||
    CASE WHEN c <> 2 AND p_partkey % 2 = 0 THEN ',attested-on-both-sides' ELSE '' END AS rules,
  CASE WHEN c = 2 THEN w[1] || ' ' || w[2] || ' x' ELSE w[1] || '|' || w[2] || ' x' END AS parts FROM w
""")
def split_proposals(spark, sf_dir):
    """Where values that may hold several names would be cut, why, and the parts."""
    size, first, last = F.col("p_size") % 5, F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    parted = F.when(size == 0, ", ").when(size == 1, " and ").when(size == 2, " ").when(size == 3, " & ").otherwise(", or ")
    rows = _parts(spark, sf_dir).select("p_partkey", F.concat(first, parted, last, F.lit(" x")).alias("value"))
    rows = rows.withColumn("tokens", interpret.tokens_of(F.col("value")))
    known = F.transform("tokens", lambda t: F.col("p_partkey") % 2 == 0)
    rows = rows.withColumn("cuts", interpret.split_proposal(F.col("value"), F.col("tokens"), known))
    rows = rows.withColumn("at", F.transform("cuts", lambda c: c["boundary"]))
    return rows.select(
        "p_partkey", "value", F.array_join(F.transform("at", lambda b: b.cast("string")), ",").alias("boundaries"),
        F.array_join(F.flatten(F.transform("cuts", lambda c: c["rules"])), ",").alias("rules"),
        F.array_join(F.transform(interpret.segments(F.col("value"), F.col("tokens"), F.col("at")), lambda p: p["text"]), "|").alias("parts"),
    )


_BLOCKS = (", Senior Director of Works", " – Finance Office", "", " (desk@example.org)", " was seen there by all of us")
_NEXT = ("Acting Director", "The day went by. Nobody came.", "all@example.org")


@query("""
WITH b AS (SELECT p_partkey, p_partkey % 5 AS c, p_partkey % 3 AS f, string_split(p_name, ' ')[2] AS last, p_size % 2 = 0 AS named FROM part),
r AS (SELECT p_partkey, [CASE WHEN c = 0 THEN 'anchor_full_name_with_role' END, CASE WHEN c = 2 AND f = 0 THEN 'anchor_signature_block' END,
  CASE WHEN named AND length(last) >= 4 THEN 'anchor_name_with_email' END, CASE WHEN c = 1 THEN 'anchor_full_name_with_organization' END] AS rules FROM b)
SELECT p_partkey, array_to_string(list_filter(rules, lambda x: x IS NOT NULL), ',') AS rules FROM r
""")
def name_anchors(spark, sf_dir):
    """Anchors of names: roles, signatures, own addresses, organizations."""
    key, last = F.col("p_partkey"), F.substring_index("p_name", " ", -1)
    name = F.initcap("p_name")
    own = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("write to j"), last, F.lit("@example.org")))
    text = F.concat(name, F.get(_texts(_BLOCKS), (key % 5).cast("int")))
    rows = _parts(spark, sf_dir).select("p_partkey", name.alias("match"), text.alias("text"), F.get(_texts(_NEXT), (key % 3).cast("int")).alias("following"), own.alias("own"))
    following = F.when((key % 3 == 0) & (key % 5 == 2), F.concat_ws(" ", "following", "own")).otherwise(F.coalesce("own", "following"))
    rules = context.anchor_rules(F.col("match"), F.col("text"), F.length("match"), following, ("director",), ("office", "department"), EMAIL)
    return rows.select("p_partkey", F.array_join(rules, ",").alias("rules"))
