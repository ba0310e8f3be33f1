"""Queries of explanations, profiles and detectors over names found in the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import explain, registry, types
from lectern.plans.catalog import query
from lectern.plans.proposals import _CANDIDATES, _named, _t
from lectern.sources.shared import written

_WEIGHTS = [
    ("plain", "strong-name-structure", 40), ("plain", "single-name-candidate", 12), ("plain", "small-frequency-bonus", 4), ("plain", "moderate-frequency-bonus", 9), ("plain", "frequency-saturated", 14),
    ("plain", "grammatical-phrase-shape", -38), ("plain", "known_first_name", 18), ("plain", "nearby-title", 30), ("strict", "strong-name-structure", 20), ("strict", "grammatical-phrase-shape", -60), ("strict", "nearby-title", 70),
]
_BANDS = [("plain", "Strong", 80), ("plain", "Possible", 25), ("plain", "Unlikely", 1), ("strict", "Strong", 90), ("strict", "Unlikely", 40)]
_TEXTS = [
    ("strong-name-structure", "Looks like a name", "it is built like a name", "Strong name structure"), ("known_first_name", "First name", "it has a known first name", "Known first name"), ("single-occurrence", "Seen once", "it occurs once", "Single occurrence"),
    ("grammatical-phrase-shape", "Phrase", "it reads like a phrase", "Grammatical phrase shape"), ("frequency-saturated", "Highly repeated", "it is repeated often", "Frequency saturated"), ("nearby-title", "Near a title", "a title stands near it", "Nearby title"),
]
_ARTICLES = ("the", "of", "and", "le", "die")
_values = lambda rows: ", ".join(str(tuple(r)) for r in rows)


def _ruled(spark, sf_dir):
    """Names of the documents with rules in order, each with its polarity."""
    rows = _named(spark, sf_dir)
    n, words = F.col("n_occurrences"), F.split(F.substr("candidate_key", F.lit(len("person:") + 1)), " ")  # not of the display value, which many don't need
    rule = lambda c, name, polarity: F.when(c, F.struct(F.lit(name).alias("category"), F.lit(polarity).alias("polarity")))
    told = F.array_compact(F.array(
        rule(n == 1, "single-occurrence", "neutral"), rule(n == 2, "small-frequency-bonus", "positive"), rule((n > 2) & (n <= 5), "moderate-frequency-bonus", "positive"), rule(n > 5, "frequency-saturated", "positive"),
        rule(F.size(words) == 2, "strong-name-structure", "positive"), rule(F.size(words) == 1, "single-name-candidate", "positive"), rule((F.size(words) == 2) & F.get(words, F.lit(1)).isin(*_ARTICLES), "grammatical-phrase-shape", "negative"),
        rule(F.col("confidence") == "high", "known_first_name", "positive"), rule(F.col("ord") == 1, "nearby-title", "positive"), rule(F.length("candidate_key") % 5 == 0, "odd-length", "negative"),
    ))
    k = F.length("candidate_key")
    kind = F.when(k % 11 == 0, "other_identifier").when(k % 13 == 0, "odd_thing").otherwise("person")
    return rows.withColumn("told", told).withColumn("detected_type", kind)


_RULED = f"""{_CANDIDATES}, r AS (
  SELECT doc_id, candidate_key, n_occurrences, CASE WHEN length(candidate_key) % 11 = 0 THEN 'other_identifier' WHEN length(candidate_key) % 13 = 0 THEN 'odd_thing' ELSE 'person' END AS detected_type,
    list_filter([
      CASE WHEN n_occurrences = 1 THEN {{'c': 'single-occurrence', 'p': 'neutral'}} WHEN n_occurrences = 2 THEN {{'c': 'small-frequency-bonus', 'p': 'positive'}} WHEN n_occurrences <= 5 THEN {{'c': 'moderate-frequency-bonus', 'p': 'positive'}} ELSE {{'c': 'frequency-saturated', 'p': 'positive'}} END,
      CASE WHEN len(w) = 2 THEN {{'c': 'strong-name-structure', 'p': 'positive'}} ELSE {{'c': 'single-name-candidate', 'p': 'positive'}} END, CASE WHEN len(w) = 2 AND w[2] IN {_ARTICLES} THEN {{'c': 'grammatical-phrase-shape', 'p': 'negative'}} END,
      CASE WHEN sure = 5 THEN {{'c': 'known_first_name', 'p': 'positive'}} END, CASE WHEN ord = 1 THEN {{'c': 'nearby-title', 'p': 'positive'}} END, CASE WHEN length(candidate_key) % 5 = 0 THEN {{'c': 'odd-length', 'p': 'negative'}} END], lambda x: x IS NOT NULL) AS told
  FROM c),
weights(profile, rule, weight) AS (VALUES {_values(_WEIGHTS)}), bands(profile, quality, least) AS (VALUES {_values(_BANDS)}),
scores AS (SELECT p.profile, r.doc_id, r.candidate_key, greatest(1, least(99, 35 + coalesce(list_sum(list_transform(told, lambda x: map_from_entries(p.w)[x.c])), 0)))::INT AS score
  FROM r, (SELECT profile, list((rule, weight)) AS w FROM weights GROUP BY 1) p)"""


def _profiles(spark):
    return spark.createDataFrame(_WEIGHTS, "profile string, rule string, weight int"), spark.createDataFrame(_BANDS, "profile string, quality string, least int")


@query(f"WITH {_RULED} SELECT profile, doc_id, candidate_key, score, (SELECT arg_max(quality, least) FROM bands b WHERE b.profile = s.profile AND b.least <= s.score) AS quality FROM scores s")
def profile_scores(spark, sf_dir):
    """Scores and qualities of names under two profiles of weights."""
    rows = _ruled(spark, sf_dir).select("doc_id", "candidate_key", F.transform("told", lambda x: x["category"]).alias("rules"))
    return registry.profiled(rows, *_profiles(spark))


_JOIN = lambda xs: f"CASE WHEN len({xs}) = 1 THEN {xs}[1] WHEN len({xs}) = 2 THEN {xs}[1] || ' and ' || {xs}[2] WHEN len({xs}) > 2 THEN {xs}[1] || ', ' || {xs}[2] || ', and ' || {xs}[3] END"
_SIDE = lambda p: f"list(told ORDER BY ord) FILTER (polarity = '{p}')"


@query(f"""WITH {_RULED}, texts(category, short, standard, expert) AS (VALUES {_values(_TEXTS)}),
e AS (SELECT doc_id, candidate_key, unnest(told).c AS category, unnest(told).p AS polarity, generate_subscripts(told, 1) AS ord FROM r),
k AS (SELECT *, array_to_string(list_transform(string_split(replace(category, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM e),
f AS (SELECT doc_id, candidate_key, ord, polarity, k.category, coalesce(standard, 'it has ' || lower(label) || ' evidence') AS told, coalesce(expert, label) AS expert FROM k LEFT JOIN texts USING (category)),
s AS (SELECT doc_id, candidate_key, {_SIDE("positive")} AS pos, {_SIDE("negative")} AS neg, {_SIDE("neutral")} AS neu, bool_and(replace(category, '_', '-') IN {explain.SHAPE_ONLY}) FILTER (polarity = 'positive') AS shape,
  array_to_string(list(expert ORDER BY ord) FILTER (polarity = 'positive'), '|') AS positive, array_to_string(list(expert ORDER BY ord) FILTER (polarity = 'negative'), '|') AS negative FROM f GROUP BY 1, 2),
t AS (SELECT doc_id, candidate_key, score, {_JOIN("pos[1:3]")} AS fors, {_JOIN("neg[1:3]")} AS against, {_JOIN("neu[1:3]")} AS rest, detected_type = 'person' AND coalesce(shape, false) AS shape_only, coalesce(positive, '') AS positive, coalesce(negative, '') AS negative,
  CASE detected_type WHEN 'person' THEN 'a person''s name' WHEN 'other_identifier' THEN 'an identifier' ELSE 'a odd thing' END AS thing, list_transform(told, lambda x: x.c) AS cats
  FROM r JOIN s USING (doc_id, candidate_key) JOIN scores USING (doc_id, candidate_key) WHERE profile = 'plain'),
u AS (SELECT *, CASE WHEN score >= 95 THEN 'Almost certainly ' WHEN score >= 80 THEN 'Likely ' WHEN score >= 50 THEN 'Possibly ' ELSE 'Unlikely to be ' END || CASE WHEN shape_only THEN 'name-shaped text' ELSE thing END AS start, CASE WHEN shape_only THEN '. No name evidence was found.' ELSE '.' END AS tail FROM t)
SELECT doc_id, candidate_key, start || CASE WHEN fors IS NOT NULL AND against IS NOT NULL THEN ' because ' || fors || ', but ' || against || tail WHEN coalesce(fors, against) IS NOT NULL THEN ' because ' || coalesce(fors, against) || tail
  ELSE ' based on deterministic evidence: ' || rest || tail END AS summary, positive, negative, CASE WHEN length(candidate_key) % 4 = 0 THEN 'Resolved: Keep' WHEN score >= 50 THEN 'To Review' ELSE 'Unlikely' END AS disposition, array_to_string(cats, '|') AS diagnostics FROM u""")
def explanations(spark, sf_dir):
    """Why names of the documents score as they do."""
    weights, bands = _profiles(spark)
    rows = _ruled(spark, sf_dir).withColumn("rules", F.transform("told", lambda x: x["category"]))
    rows, _ = written(registry.under_profiles(rows, weights.filter("profile = 'plain'"), bands.filter("profile = 'plain'")).withColumnRenamed("score", "likelihood"))  # read for facts and evidence
    evidence = rows.select("doc_id", "candidate_key", F.posexplode("told").alias("ord", "e")).select("doc_id", "candidate_key", "ord", "e.category", "e.polarity").join(weights.filter("profile = 'plain'").select(F.col("rule").alias("category"), "weight"), "category", "left")
    facts = rows.select(
        "doc_id", "candidate_key", "detected_type", "likelihood", F.when(F.col("likelihood") >= 50, "ToReview").otherwise("Unlikely").alias("recommendation"), "n_occurrences",
        F.when(F.length("candidate_key") % 4 == 0, "Keep").alias("decision"), F.array().cast("array<string>").alias("filter_rules"), F.col("rules").alias("reasons"),
    )
    found = explain.explanations(facts, evidence, spark.createDataFrame(_TEXTS, "category string, short string, standard string, expert string"))
    return found.select("doc_id", "candidate_key", "summary", *[explain.told(s, "|") for s in ("positive", "negative")], "disposition", F.array_join("diagnostics", "|").alias("diagnostics"))


_CODES = """s AS (SELECT source AS doc_id, 'doc ' || lang || '-' || doc_id AS v FROM documents UNION ALL SELECT source, lang || doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT source, 'Doc ' || upper(lang) FROM documents UNION ALL SELECT source, 'D' || upper(lang[1]) FROM documents WHERE doc_id % 2 = 0),
g AS (SELECT doc_id, lower(v) AS k, min(v) AS v FROM s GROUP BY 1, 2)"""


@query(rf"""WITH {_CODES},
p AS (SELECT doc_id, regexp_replace(regexp_replace(v, '[0-9]', '#', 'g'), '[A-Za-z]', 'A', 'g') AS detail, list(k ORDER BY k) AS members FROM g WHERE length(v) >= 4 AND regexp_matches(v, '[0-9]') AND regexp_full_match(v, '[A-Za-z0-9._/-]+') GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT a.doc_id, a.k AS key, arg_max(b.k, (length(b.k), b.k)) AS long_key FROM g a JOIN g b ON a.doc_id = b.doc_id AND starts_with(b.k, a.k || ' ') GROUP BY 1, 2),
i AS (SELECT doc_id, k, array_to_string(list_transform(list_filter(string_split(v, ' '), lambda w: regexp_matches(w, '^[A-Z]')), lambda w: w[1]), '') AS a FROM g),
x AS (SELECT g.doc_id, g.k AS key, i.k AS long_key, g.v AS detail FROM g JOIN i ON i.doc_id = g.doc_id AND i.a = g.v WHERE regexp_full_match(g.v, '[A-Z][A-Z]+') AND i.k <> g.k)
SELECT doc_id, 'identifier-pattern' AS detector, 'alphanumeric-identifier' AS kind, array_to_string(members, ',') AS members, detail FROM p
UNION ALL SELECT doc_id, 'truncated-variant', 'truncated-variant', key || ',' || long_key, long_key FROM t UNION ALL SELECT doc_id, 'acronym-expansion', 'acronym-expansion', key || ',' || long_key, detail FROM x""")
def relationship_proposals(spark, sf_dir):
    """All registered detectors over labels made of the documents' languages and ids, by source."""
    d = _t(spark, sf_dir, "documents")
    id_ = F.col("doc_id").cast("string")
    made = lambda rows, value: rows.select(F.col("source").alias("s"), value.alias("v"))
    rows = made(d, F.concat(F.lit("doc "), "lang", F.lit("-"), id_)).unionByName(made(d.filter("doc_id % 3 = 0"), F.concat("lang", id_))).unionByName(made(d, F.concat(F.lit("Doc "), F.upper("lang")))).unionByName(made(d.filter("doc_id % 2 = 0"), F.concat(F.lit("D"), F.upper(F.substring("lang", 1, 1)))))
    scored = rows.groupBy(F.col("s").alias("doc_id"), F.lower("v").alias("candidate_key")).agg(F.min("v").alias("display_value")).withColumn("detected_type", F.lit("person"))
    return registry.relationships(scored).withColumn("members", F.array_join("members", ",")).drop("proposal_id")


_KINDS = ["shortened-name", "semantic-alias", "acronym", "identifier", "institutional-term", "calendar-term", "common-word", "uncertain"]
_QUEUE = f"""{_RULED}, i AS (SELECT r.doc_id, r.candidate_key, r.detected_type, {_KINDS}[CASE WHEN length(r.candidate_key) % 9 = 8 THEN NULL ELSE length(r.candidate_key) % 9 + 1 END] AS archetype, r.n_occurrences % 2 = 0 AS organization, len(list_filter(told, lambda x: x.c = 'known_first_name')) > 0 AS named,
  CASE length(r.candidate_key) % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'needs-review' WHEN 2 THEN 'odd' END AS tier, ord FROM r JOIN c USING (doc_id, candidate_key)),
s AS (SELECT *, CASE WHEN archetype = 'semantic-alias' THEN CASE WHEN organization THEN 'org-aliases' ELSE 'nicknames' END WHEN archetype IN {tuple(types.ARCHETYPES)} THEN map({list(types.ARCHETYPES)}, {list(types.ARCHETYPES.values())})[archetype]
  WHEN detected_type <> 'person' THEN 'other' WHEN named THEN 'shortened-names' ELSE 'common-words' END AS section FROM i),
q AS (SELECT doc_id, candidate_key, section, map({list(types.AMBIGUOUS)}, {list(types.AMBIGUOUS.values())})[section] AS label, CASE WHEN tier <> 'odd' THEN tier END AS tier,
  row_number() OVER (PARTITION BY doc_id ORDER BY list_position({list(types.AMBIGUOUS)}, section), CASE tier WHEN 'strong' THEN 1 WHEN 'needs-review' THEN 2 ELSE 3 END, ord, candidate_key)::INT AS place FROM s)"""


def _queue(spark, sf_dir):
    rows, k = _ruled(spark, sf_dir), F.length("candidate_key")
    return types.ambiguity_queue(rows.select(
        "doc_id", "candidate_key", "detected_type", F.get(F.array(*map(F.lit, _KINDS)), k % 9).alias("archetype"), (F.col("n_occurrences") % 2 == 0).alias("organization"),
        F.exists("told", lambda x: x["category"] == "known_first_name").alias("named"), F.when(k % 4 == 0, "strong").when(k % 4 == 1, "needs-review").when(k % 4 == 2, "odd").alias("tier"), "ord",
    ))


@query(f"WITH {_QUEUE} SELECT * FROM q")
def ambiguity_queue(spark, sf_dir):
    """Names of the documents in the order in which their ambiguities are shown."""
    return _queue(spark, sf_dir)


@query(f"WITH {_QUEUE} SELECT doc_id, section, label, count(*) AS n, count(*) FILTER (tier = 'strong') AS n_strong, count(*) FILTER (tier = 'needs-review') AS n_needs_review, min(place) AS first_place FROM q GROUP BY 1, 2, 3")
def ambiguity_sections(spark, sf_dir):
    return types.ambiguity_sections(_queue(spark, sf_dir))
