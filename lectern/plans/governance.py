"""Queries over scores, redaction, clusters and stars of tables."""

from pyspark.sql import functions as F

from lectern.operators import corpus, detect, quality, redact
from lectern.plans.catalog import query
from lectern.sources.shared import spread, written


def _docs(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query()
def quality_scores(spark, sf_dir):
    """Candidates with their evidence, score and label."""
    found = detect.candidates(detect.occurrences(detect.blocks(_docs(spark, sf_dir))))
    return quality.scored(found).withColumn("rules", F.array_join("rules", ","))


@query()
def evidence_histogram(spark, sf_dir):
    found = detect.candidates(detect.occurrences(detect.blocks(_docs(spark, sf_dir))))
    return quality.scored(found).select(F.explode("rules").alias("rule"), "quality").groupBy("rule", "quality").agg(F.count("*").alias("n"))


@query()
def redacted_text(spark, sf_dir):
    """All blocks after replacing every occurrence by its placeholder."""
    rows = detect.blocks(_docs(spark, sf_dir))
    return redact.redacted(rows, detect.numbered(detect.occurrences(rows).drop("context", "match")))


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_order FROM documents),
seen AS (SELECT DISTINCT doc_id, block_order, line, unnest(regexp_extract_all(line, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS match FROM lines)
SELECT doc_id, block_order::BIGINT AS block_order, match, (len(string_split(line, match)) - 1)::BIGINT AS n FROM seen
""")
def residual_scan(spark, sf_dir):
    """E-mail addresses that the blocks hold, and how often, when nothing has been redacted."""
    rows, keys = detect.blocks(_docs(spark, sf_dir)), ["doc_id", "block_order"]
    found, _ = written(detect.occurrences(rows, ("email",)).select(*keys, "match").distinct())
    held, _ = written(rows.join(found.select(*keys).distinct(), keys, "left_semi"))  # only these can hold one
    met = redact.residue(held, found).join(found, [*keys, "match"]).join(held, keys)
    return met.select("doc_id", F.col("block_order").cast("long").alias("block_order"), "match", (F.size(F.split("text", F.concat(F.lit("\\Q"), "match", F.lit("\\E")), -1)) - 1).cast("long").alias("n"))


@query(r"""
WITH d AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b', 1))) AS item FROM documents)
SELECT item, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM d
WHERE item NOT IN (DOMAINS) GROUP BY 1
""".replace("DOMAINS", ", ".join(f"'{d}'" for d in corpus.GENERIC_DOMAINS)))
def shared_domains(spark, sf_dir):
    """Private mail domains with the documents that share them."""
    return corpus.email_domains(_docs(spark, sf_dir)).groupBy(F.col("domain").alias("item")).agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())
""")
def usage_rollup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.rollup("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf_dir):
    s, c = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "customer"))
    return s.select(F.col("s_nationkey").alias("nation")).union(c.select("c_nationkey")).distinct()


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_distinct(spark, sf_dir):
    n, s = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("nation", "supplier"))
    return n.select(F.col("n_nationkey").alias("nation")).subtract(s.filter("s_acctbal > 5000").select("s_nationkey"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1
""")
def status_crosstab(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return rows.select("o_orderpriority", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "FOP"])


_PACKS = (
    ("common_english_word", "small"), ("common_english_word", "cold"), ("calendar_term", "widget"), ("department_organization", "cold widget"), ("given_names", "red"),
)


@query("""
WITH v AS (SELECT p_partkey, p_brand, p_partkey % 4 AS c, p_partkey % 3 + 1 AS n, p_size % 6 AS k, string_split(p_name, ' ') AS w FROM part),
f AS (SELECT *, CASE WHEN k = 3 THEN w[1:1] ELSE list_distinct(w) END AS words FROM v),
g AS (SELECT *, k = 3 AS one, list_has_any(words, ['small', 'cold']) AS common, list_contains(words, 'widget') AS calendar, k NOT IN (3, 4) AND w = ['cold', 'widget'] AS dept,
  list_contains(words, 'red') AS given, len(list_intersect(words, ['small', 'cold', 'widget'])) = len(words) AS every,
  CASE n WHEN 1 THEN -4 WHEN 2 THEN 4 ELSE 9 END AS often, CASE c WHEN 0 THEN 40 WHEN 1 THEN 22 ELSE 0 END AS said FROM f),
h AS (SELECT *, said > 0 OR (one AND given) AS positive, common OR calendar OR dept OR every OR k = 5 AS negative,
  CASE WHEN common THEN -28 ELSE 0 END + CASE WHEN calendar THEN -22 ELSE 0 END + CASE WHEN dept THEN -22 ELSE 0 END + CASE WHEN every THEN -18 ELSE 0 END
  + CASE WHEN k = 5 THEN -28 ELSE 0 END + CASE WHEN one AND given THEN 28 ELSE 0 END AS classes, CASE WHEN given THEN 20 ELSE 0 END AS known FROM g),
s AS (SELECT *, greatest(1, least(99, 35 + often + CASE
  WHEN negative AND NOT positive THEN classes - 5 WHEN k = 4 THEN said + classes + 50 + known
  WHEN k < 3 AND c = 2 AND NOT positive THEN 35 + known - 12 WHEN k < 3 THEN said + classes + 35 + known
  WHEN one AND positive THEN said + classes + 8 WHEN one THEN classes + 12 ELSE said + classes - 5 END)) AS score FROM h)
SELECT p_brand AS doc_id, p_partkey, score::INT AS score, CASE WHEN score >= 80 THEN 'Strong' WHEN score >= 25 THEN 'Possible' ELSE 'Unlikely' END AS quality FROM s
""")
def weighted_quality(spark, sf_dir):
    """Names of parts as people, written in six ways in four surroundings, scored by packs, surroundings and shapes."""
    k, c, name = F.col("p_size") % 6, F.col("p_partkey") % 4, F.initcap("p_name")
    first, last = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    value = F.when(k == 3, first).when(k == 4, F.concat(last, F.lit(", "), first)).when(k == 5, F.col("p_name")).otherwise(name)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("doc_id"), "p_partkey", F.col("p_partkey").cast("string").alias("candidate_key"), F.lit("person").alias("detected_type"), value.alias("display_value"),
        F.when(c == 0, "ask Dr. [").when(c == 1, "From: [").when(c == 2, "Subject: x [").otherwise("see [").alias("before"), F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))).alias("i"),
    )
    found = rows.select("doc_id", "candidate_key", F.concat("before", "display_value", F.lit("] then")).alias("context"))
    candidates = rows.filter("i = 0").select("doc_id", "candidate_key", "detected_type", "display_value")
    packs = spark.createDataFrame(_PACKS, "rule string, term string")
    scored = quality.cascade(candidates, quality.surroundings(found, candidates), packs)
    return scored.select("doc_id", F.col("candidate_key").cast("int").alias("p_partkey"), "score", "quality")
