"""Queries over documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import corpus, detect
from lectern.plans.catalog import query
from lectern.sources.shared import spread

_WORDS = ", ".join(f"'{w}'" for w in corpus.STOPWORDS)
_ACRONYMS = ", ".join(f"'{w}'" for w in corpus.GENERIC_ACRONYMS)
_DOMAINS = ", ".join(f"'{w}'" for w in corpus.GENERIC_DOMAINS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query()
def detect_candidates(spark, sf_dir):
    """Candidates of all types with their counts, over all blocks."""
    return detect.candidates(detect.occurrences(detect.blocks(_docs(spark, sf_dir))))


@query()
def occurrence_contexts(spark, sf_dir):
    """Every occurrence with offsets, context, ordinal and placeholder."""
    return detect.numbered(detect.occurrences(detect.blocks(_docs(spark, sf_dir))))


@query()
def single_name_frequency(spark, sf_dir):
    return detect.single_names(detect.blocks(_docs(spark, sf_dir)))


@query(r"""
SELECT doc_id, 'email:' || lower(m) AS candidate_key, count(*) AS n_occurrences FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS m FROM documents)
GROUP BY 1, 2
""")
def detect_email_candidates(spark, sf_dir):
    found = detect.occurrences(detect.blocks(_docs(spark, sf_dir))).filter("detected_type = 'email'")
    return found.groupBy("doc_id", "candidate_key").agg(F.count("*").alias("n_occurrences"))


@query(r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS f,
  string_split_regex(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS g FROM documents),
n AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m)
SELECT doc_id, f[i] AS match,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::INT AS start_at
FROM n
""")
def email_offsets(spark, sf_dir):
    from lectern.functions.text import matches

    rows = _docs(spark, sf_dir).select("doc_id", F.explode(matches(F.col("text"), detect.EMAIL)).alias("m"))
    return rows.select("doc_id", F.col("m.text").alias("match"), F.col("m.start").alias("start_at"))


@query(rf"""
SELECT doc_id, acronym, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{{2,6}}\b')) AS acronym FROM documents)
WHERE acronym NOT IN ({_ACRONYMS}) GROUP BY 1, 2 HAVING count(*) >= 2
""")
def detect_acronyms(spark, sf_dir):
    return corpus.acronyms(_docs(spark, sf_dir))


@query(rf"""
SELECT doc_id, domain, count(*) AS n FROM (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})\b', 1))) AS domain FROM documents)
WHERE domain NOT IN ({_DOMAINS}) GROUP BY 1, 2
""")
def email_domains(spark, sf_dir):
    return corpus.email_domains(_docs(spark, sf_dir))


@query(rf"""
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z]{{4,}}'))) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE term NOT IN ({_WORDS}) GROUP BY 1, 2)
SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)::INT AS place FROM c
QUALIFY place <= 5
""")
def doc_top_terms(spark, sf_dir):
    return corpus.top_terms(_docs(spark, sf_dir))


@query(r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, len(a) AS n, CASE WHEN len(a) > 0 THEN list_sum(list_transform(a, lambda x: length(x))) / len(a) ELSE 0 END AS m FROM p)
SELECT doc_id, 'p' || ((n >= 10)::INT + (n >= 50)::INT + (n >= 200)::INT + (n >= 1000)::INT) || '-l' || ((m >= 40)::INT + (m >= 100)::INT + (m >= 250)::INT) AS signature FROM s
""")
def structure_signature(spark, sf_dir):
    return corpus.structure(_docs(spark, sf_dir))


@query(rf"""
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z]{{4,}}'))) AS term FROM documents)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t WHERE term NOT IN ({_WORDS}) GROUP BY 1
""")
def term_frequency(spark, sf_dir):
    per_doc = corpus.terms(_docs(spark, sf_dir))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query("""
SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS value,
  regexp_replace(regexp_replace(p_brand, '[0-9]', '#', 'g'), '[A-Za-z]', 'A', 'g') AS shape, count(*) AS n FROM part GROUP BY 1, 2
""".replace("\\\\", "\\"))
def identifier_shapes(spark, sf_dir):
    from lectern.functions.text import shape, squeeze

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy(F.lower(squeeze(F.col("p_name"))).alias("value"), shape(F.col("p_brand")).alias("shape")).agg(F.count("*").alias("n"))
