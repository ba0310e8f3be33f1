"""Queries over evidence across candidates, document scores and stages."""

from pyspark.sql import functions as F

from lectern.operators import detect, scores, types
from lectern.plans.catalog import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH p AS (SELECT p_size AS doc_id, p_partkey::VARCHAR AS candidate_key, p_name || ' ' || p_type AS v FROM part),
w AS (SELECT *, string_split(lower(v), ' ') AS a FROM p), e AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM w), f AS (SELECT doc_id, candidate_key, v, a[i] AS word, i, len(a) AS n FROM e),
s AS (SELECT doc_id, word, count(DISTINCT v) AS share, count(DISTINCT CASE WHEN i = n THEN v END) AS as_last FROM f GROUP BY 1, 2),
r AS (SELECT f.doc_id, candidate_key, max(share) AS word_share, arg_max(f.word, share * 100 - i) AS shared_word, max(CASE WHEN i = n THEN as_last END) AS last_share FROM f JOIN s ON f.doc_id = s.doc_id AND f.word = s.word GROUP BY 1, 2)
SELECT *, concat_ws(',', CASE WHEN word_share >= 3 THEN 'token_recurrence' END, CASE WHEN last_share >= 2 THEN 'head_noun_paradigm' END) AS rules FROM r WHERE word_share >= 3 OR last_share >= 2
""")
def shared_words(spark, sf_dir):
    """Parts as values, their sizes as documents."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").cast("string").alias("candidate_key"), F.lit("person").alias("detected_type"), F.concat_ws(" ", "p_name", "p_type").alias("display_value"))
    return scores.shared_words(rows).withColumn("rules", F.array_join("rules", ","))


@query()
def shared_name_words(spark, sf_dir):
    """The same over the people of the documents."""
    found = detect.candidates(detect.occurrences(detect.blocks(_t(spark, sf_dir, "documents").select("doc_id", "text"))))
    return scores.shared_words(found).withColumn("rules", F.array_join("rules", ","))


@query("""
WITH f AS (SELECT user_id AS doc_id, count(*) FILTER (event_type = 'error') AS warnings, count(*) FILTER (value > 60) AS unsupported, 0 AS images, count(*) AS items, count(*) FILTER (event_type IN ('click', 'purchase')) AS resolved,
  CASE WHEN user_id % 3 = 0 THEN user_id % 2 = 0 END AS passed, user_id % 4 AS ow, user_id % 2 AS ob FROM events GROUP BY 1),
g AS (SELECT doc_id, greatest(0, least(100, 100.0::DOUBLE - 3 * warnings - 5 * unsupported)) AS x, 100.0::DOUBLE * resolved / items AS r, CASE WHEN passed IS NULL THEN 0 ELSE CASE WHEN passed THEN 15 ELSE 0 END - 10 * ow - 25 * ob END AS o FROM f)
SELECT doc_id, floor(x * 10 + 0.5) / 10 AS extraction, floor(r * 10 + 0.5) / 10 AS review, floor(greatest(0, least(100, 0.3::DOUBLE * x + 0.55::DOUBLE * r + o)) * 10 + 0.5) / 10 AS overall FROM g
""")
def document_scores(spark, sf_dir):
    """Users as documents, their events as items."""
    f = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(
        F.count_if(F.col("event_type") == "error").alias("warnings"), F.count_if(F.col("value") > 60).alias("unsupported"), F.lit(0).alias("images"), F.count("*").alias("items"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("resolved"),
    )
    return scores.document_scores(f.select("*", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("passed"), (F.col("doc_id") % 4).alias("output_warnings"), (F.col("doc_id") % 2).alias("output_blockers")))


@query("""
SELECT o_custkey AS doc_id, o_orderpriority AS stage, count(*) AS items, count(*) FILTER (o_orderstatus <> 'F') AS unresolved, count(*) FILTER (o_orderstatus <> 'F') = 0 AS complete FROM orders GROUP BY 1, 2
""")
def stage_status(spark, sf_dir):
    return scores.stage_status(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("stage"), (F.col("o_orderstatus") == "F").alias("resolved")))


@query("SELECT l_suppkey AS doc_id, l_returnflag AS cohort, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 8")
def cohorts(spark, sf_dir):
    return scores.cohorts(_t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("cohort"), F.col("l_partkey").alias("candidate_key")))


# --- groups, stages and tiers -------------------------------------------------------------------


@query("""
WITH m AS (SELECT p_brand, CASE WHEN p_size % 9 > 0 THEN p_size + 40 END AS score, p_size % 5 > 1 AS selected, p_size % 3 AS n_tokens, p_partkey % 97 = 3 AS confirmed FROM part),
g AS (SELECT p_brand, bool_or(confirmed) AS confirmed, count(score) FILTER (selected) AS n, min(score) FILTER (selected) AS least, avg(score) FILTER (selected) AS mean,
  coalesce(bool_or(n_tokens >= 2) FILTER (selected AND score IS NOT NULL), false) AS anchor FROM m GROUP BY 1)
SELECT p_brand, CASE WHEN n = 0 THEN 0 ELSE greatest(35, least(100, round_even(least * 0.65::DOUBLE + mean * 0.35::DOUBLE, 0) - CASE WHEN n > 1 AND NOT anchor THEN 15 ELSE 0 END + CASE WHEN confirmed THEN 10 ELSE 0 END)) END::INT AS confidence FROM g
""")
def entity_confidence(spark, sf_dir):
    size = F.col("p_size")
    members = _t(spark, sf_dir, "part").select(
        "p_brand", F.when(size % 9 > 0, size + 40).alias("score"), (size % 5 > 1).alias("selected"), (size % 3).alias("n_tokens"), (F.col("p_partkey") % 97 == 3).alias("confirmed")
    )
    return scores.entity_confidence(members, "p_brand")


@query("""
SELECT p_partkey, greatest(35, least(99, p_size + 60 - (24 - 4 * (p_partkey % 5 + 1))))::DOUBLE AS by_name, greatest(35, least(99, p_size + 60 - (30 - 5 * (p_partkey % 5 + 1))))::DOUBLE AS by_value FROM part
""")
def related_confidence(spark, sf_dir):
    """Confidence over relations of names and of whole values."""
    found, strength = F.col("p_size") + 60, F.col("p_partkey") % 5 + 1
    return _t(spark, sf_dir, "part").select("p_partkey", *[scores.related_confidence(found, strength, of).cast("double").alias(f"by_{of}") for of in ("name", "value")])


@query("""
WITH s AS (SELECT p_partkey, ['ambiguity-check', 'group-check', 'type-check', 'item-check', 'qa', 'output'] AS o, p_partkey % 7 AS cur, p_size % 3 AS a, p_size % 7 AS b FROM part),
p AS (SELECT *, CASE WHEN cur = 0 THEN 1 ELSE cur END AS here, list_filter(list_distinct([a * 2, b]), lambda x: x BETWEEN 1 AND 6) AS places FROM s)
SELECT p_partkey, o[coalesce(list_min(list_filter(places, lambda x: x >= here)), list_max(list_filter(places, lambda x: x < here)), 6)] AS stage FROM p
""")
def nearest_stage(spark, sf_dir):
    """The stage to go to when the current one has nothing left."""
    every = F.array(F.lit("elsewhere"), *[F.lit(x) for x in scores.STAGES])
    one = lambda i: F.get(every, i.cast("int"))
    active = F.array(one(F.col("p_size") % 3 * 2), one(F.col("p_size") % 7))
    return _t(spark, sf_dir, "part").select("p_partkey", scores.nearest_stage(one(F.col("p_partkey") % 7), active).alias("stage"))


@query("""
SELECT p_brand, count(*) AS n_proposed, count(*) FILTER (p_size % 4 <> 0) AS n_included, count(*) FILTER (p_size % 4 = 0) AS n_excluded FROM part GROUP BY 1
""")
def scan_counts(spark, sf_dir):
    """Members of cohorts that a group action will touch, and those that it won't."""
    members = _t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("candidate_key"), "p_size")
    return scores.scan_counts(members.drop("p_size"), members.filter("p_size % 4 = 0"), "p_brand")


@query("""
WITH m AS (SELECT CASE WHEN s_suppkey % 6 = 0 THEN 100 + s_nationkey % 2 ELSE s_nationkey END AS g, s_suppkey AS d FROM supplier),
r AS (SELECT CASE WHEN g = 3 THEN 4 ELSE g END AS group_id, d FROM m),
p AS (SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, max(l_quantity)::DOUBLE AS score FROM lineitem GROUP BY 1, 2),
every AS (SELECT x.group_id, count(*) AS n, min(coalesce(score, 0)) AS least FROM r x JOIN r y ON x.group_id = y.group_id AND x.d < y.d LEFT JOIN p ON p.a = x.d AND p.b = y.d GROUP BY 1)
SELECT r.group_id::BIGINT AS group_id, count(*) AS n_members, any_value(least) AS strength FROM r LEFT JOIN every USING (group_id) GROUP BY 1
""")
def regrouped_documents(spark, sf_dir):
    """Groups of documents after splits and merges, with the least score of all their pairs."""
    suppliers = _t(spark, sf_dir, "supplier")
    members = suppliers.select(F.col("s_nationkey").cast("bigint").alias("group_id"), F.col("s_suppkey").alias("doc_id"))
    splits = suppliers.filter("s_suppkey % 6 = 0").select(F.col("s_suppkey").alias("doc_id"), (F.lit(100) + F.col("s_nationkey") % 2).cast("bigint").alias("new_group"))
    merges = spark.range(1).select(F.lit(3).cast("bigint").alias("group_id"), F.lit(4).cast("bigint").alias("into"))
    pairs = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), F.col("l_quantity").cast("double").alias("score"))
    return scores.group_strength(scores.regrouped(members, splits, merges), pairs)


@query("""
WITH f AS (SELECT p_partkey, (['acronym', 'identifier', 'calendar-term', 'uncertain', NULL])[p_size % 5 + 1] AS archetype, p_partkey % 3 AS n_suggestions, p_size % 2 = 0 AS person, p_partkey % 4 AS n_tokens FROM part)
SELECT p_partkey, CASE WHEN archetype <> 'uncertain' THEN CASE WHEN n_suggestions > 0 OR archetype <> 'acronym' THEN 'strong' ELSE 'needs-review' END
  WHEN person AND n_tokens >= 1 AND p_partkey % 2 = 1 THEN 'needs-review' END AS tier FROM f
""")
def review_tiers(spark, sf_dir):
    """How strongly recommendations are put."""
    size, key = F.col("p_size"), F.col("p_partkey")
    archetype = F.get(F.array(*[F.lit(x) for x in ("acronym", "identifier", "calendar-term", "uncertain")]), (size % 5).cast("int"))
    kind, known = F.when(size % 2 == 0, "person").otherwise("organization"), F.array(F.lit("known-first-name"))
    return _t(spark, sf_dir, "part").select("p_partkey", types.review_tier(archetype, key % 3, kind, key % 4, known, key % 2).alias("tier"))
