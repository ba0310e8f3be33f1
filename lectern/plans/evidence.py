"""Queries over evidence, lexicons, reports and windows."""

from pyspark.sql import functions as F

from lectern.operators import corpus, detect, evidence, relate
from lectern.plans.catalog import query
from lectern.streaming import activity
from lectern.sources import reports
from lectern.sources.shared import spread


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))


_P = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_LEN = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), m AS (SELECT doc_id, t, regexp_extract_all(t, '{_P}') AS f, string_split_regex(t, '{_P}') AS g FROM l WHERE contains(t, '@')),
n AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m), o AS (SELECT doc_id, t, f[i] AS v, ({_LEN("g[1:i]")} + {_LEN("f[1:i-1]")})::INT AS s FROM n),
c AS (SELECT doc_id, 'email:' || lower(v) AS candidate_key, CASE WHEN s > 70 THEN '...' ELSE '' END || substring(t, greatest(s - 70, 0) + 1, s - greatest(s - 70, 0)) || '[' || v || ']' ||
  substring(t, s + length(v) + 1, 70) || CASE WHEN s + length(v) + 70 < length(t) THEN '...' ELSE '' END AS context FROM o),
r AS (SELECT doc_id, candidate_key, string_split(regexp_replace(trim(regexp_replace(replace(replace(context, '...', ' '), chr(160), ' '), '\s+', ' ', 'g')), '^(.*?)\[[^\]]+\]', '\1 '), ' ') AS w FROM c),
k AS (SELECT doc_id, candidate_key, CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z0-9]') AND NOT regexp_full_match(lower(trim(x, '.,;:()[]{{}}<>')), 'l|r|lr|br|cr|lf|nbsp|\\n|\\r|\\t|[^A-Za-z0-9]+'))) > 0 THEN 'contextual' ELSE 'standalone' END AS kind FROM r)
SELECT doc_id, candidate_key, kind, count(*) AS n FROM k GROUP BY GROUPING SETS ((kind), (doc_id, candidate_key, kind))
""")
def occurrence_kind_counts(spark, sf_dir):
    """Kinds of the occurrences of mail addresses, in all and for each candidate."""
    return evidence.kind_counts(detect.occurrences(detect.blocks(_docs(spark, sf_dir))).filter("detected_type = 'email'"))


@query()
def cut_values(spark, sf_dir):
    """Origins of the names that detection may have cut."""
    rows = detect.blocks(_docs(spark, sf_dir))
    found = detect.occurrences(rows).filter("detected_type = 'person'").select("doc_id", "block_order", "end", "match")
    return evidence.cut_report(found.join(rows, ["doc_id", "block_order"]))


def _packs(spark, sf_dir):
    """Names of parts as lexicons: a family for every type, the size as risk; first words too, as terms of their own."""
    p = _t(spark, sf_dir, "part").select(F.lower("p_type").alias("family"), F.lower("p_name").alias("phrase"), F.col("p_size").alias("risk"))
    return p.filter("risk % 3 = 0").unionByName(p.filter("risk % 7 = 0").withColumn("phrase", F.split("phrase", " ")[0]))


_PACKS = """b AS (SELECT lower(p_type) AS family, lower(p_name) AS phrase, p_size AS risk FROM part),
k AS (SELECT * FROM b WHERE risk % 3 = 0 UNION ALL SELECT family, string_split(phrase, ' ')[1], risk FROM b WHERE risk % 7 = 0)"""


@query(f"""
WITH {_PACKS}, h AS (SELECT family, phrase, count(*) AS n_rows FROM k GROUP BY 1, 2), v AS (SELECT DISTINCT p_name AS value, lower(p_name) AS normal FROM part),
w AS (SELECT value, family, 'phrase' AS how, n_rows FROM v JOIN h ON normal = phrase), x AS (SELECT DISTINCT value, unnest(string_split(normal, ' ')) AS word FROM v),
y AS (SELECT value, family, 'word' AS how, sum(n_rows)::BIGINT AS n_rows FROM x JOIN h ON word = phrase GROUP BY 1, 2)
SELECT * FROM w UNION ALL SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.value = y.value AND w.family = y.family)
""")
def lexicon_attestation(spark, sf_dir):
    return evidence.attested(_t(spark, sf_dir, "part").select(F.col("p_name").alias("value")), _packs(spark, sf_dir))


@query(f"WITH {_PACKS}, h AS (SELECT DISTINCT family, phrase FROM k) SELECT x.family AS a, y.family AS b, count(*) AS n FROM h x JOIN h y ON x.phrase = y.phrase AND x.family <= y.family GROUP BY 1, 2")
def lexicon_overlap_matrix(spark, sf_dir):
    return evidence.overlaps(_packs(spark, sf_dir))


@query(f"WITH {_PACKS} SELECT phrase, array_to_string(list_sort(list(DISTINCT family)), ',') AS families, count(*) AS n_rows, max(risk) AS risk FROM k GROUP BY 1")
def lexicon_phrases(spark, sf_dir):
    return evidence.phrase_profile(_packs(spark, sf_dir)).withColumn("families", F.array_join("families", ","))


@query()
def near_form_tokens(spark, sf_dir):
    """Rare words of the documents and the words of at least five documents that they nearly are."""
    words = corpus.terms(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n")).withColumnRenamed("term", "word")
    return evidence.near_forms(words.filter("n < 5"), words.filter("n >= 5"))


@query("""
WITH r AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT a, b, max(s) AS strength FROM (SELECT a, b, s FROM r UNION ALL SELECT b, a, s FROM r) GROUP BY 1, 2
""")
def symmetric_relations(spark, sf_dir):
    return evidence.both_ways(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("strength")))


def _decided(spark, sf_dir):
    decision = F.when(F.col("o_orderstatus") == "F", "Redact").when(F.col("o_orderpriority").startswith("1"), "Keep").when(F.col("o_orderpriority").startswith("2"), "Not sensitive")
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("candidate_key"), F.col("o_orderpriority").alias("detected_type"), decision.alias("decision"), F.lit("[X]").alias("replacement"),
        F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low").alias("confidence"))


_DECIDED = """d AS (SELECT o_custkey AS doc_id, o_orderkey::VARCHAR AS candidate_key, o_orderpriority AS detected_type, CASE WHEN o_orderstatus = 'F' THEN 'Redact' WHEN o_orderpriority LIKE '1%' THEN 'Keep' WHEN o_orderpriority LIKE '2%' THEN 'Not sensitive' END AS decision,
  CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS confidence, o_orderkey FROM orders)"""


@query(f"""
WITH {_DECIDED} SELECT doc_id, candidate_key, detected_type, coalesce(decision, 'Undecided') AS decision, CASE WHEN decision IS NULL THEN '' ELSE '[X]' END AS replacement, coalesce(l_partkey::VARCHAR, '') AS occurrence_id, coalesce(l_linenumber::VARCHAR, '') AS block_order
FROM d LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 40) ON l_orderkey = o_orderkey
""")
def audit_rows(spark, sf_dir):
    """Orders as candidates, their large lines as occurrences."""
    rows = _decided(spark, sf_dir)
    lines = _t(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").cast("string").alias("candidate_key"), F.col("l_partkey").alias("occurrence_id"), F.col("l_linenumber").alias("block_order"))
    found = lines.join(rows.select("doc_id", "candidate_key"), "candidate_key")
    return reports.audit_rows(rows.select("doc_id", "candidate_key", "detected_type"), found, rows.filter("decision is not null"))


_SHARE = lambda d: f"round(count(*) FILTER (decision = '{d}') * 100.0::DOUBLE / count(*), 2)"


@query(f"""
WITH {_DECIDED} SELECT detected_type, count(*) AS total, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low,
  count(*) FILTER (decision = 'Redact') AS redacted, count(*) FILTER (decision = 'Rename') AS renamed, count(*) FILTER (decision = 'Keep') AS kept, count(*) FILTER (decision = 'Not sensitive') AS wrong_match, count(*) FILTER (decision = 'Review') AS review,
  count(*) FILTER (decision IS NULL) AS undecided, {_SHARE("Redact")} AS percent_redacted, {_SHARE("Rename")} AS percent_renamed, {_SHARE("Keep")} AS percent_kept, {_SHARE("Not sensitive")} AS percent_wrong_match FROM d GROUP BY 1
""")
def qa_metrics(spark, sf_dir):
    return reports.metrics(_decided(spark, sf_dir), "detected_type")


@query(f"WITH {_DECIDED} SELECT doc_id, candidate_key, decision, '[X]' AS replacement FROM d WHERE decision IS NOT NULL")
def decision_round_trip(spark, sf_dir):
    """Decisions written as one JSON record a document, and read again."""
    good, _ = reports.read_decisions(reports.decision_records(_decided(spark, sf_dir).filter("decision is not null")).select("json"))
    return good


@query("""
WITH w AS (SELECT event_type, unnest(generate_series(0, 3)) AS k, epoch_us(ts) AS t FROM events)
SELECT event_type, (t // 21600000000 - k) * 21600000000 AS start_us, count(*) AS n FROM w GROUP BY 1, 2
""")
def sliding_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return activity.sliding(rows).select("event_type", F.unix_micros("window.start").alias("start_us"), "n")


@query("""
WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, event_id FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return activity.sessions(rows).select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l WHERE NOT starts_with(href, '#') GROUP BY 1, 2
""")
def page_links(spark, sf_dir):
    """Links of pages, without those inside the page."""
    found = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href")).filter(~F.col("href").startswith("#")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND (length(x.n_name), x.n_name) < (length(y.n_name), y.n_name)")
def theta_join(spark, sf_dir):
    """Equal regions, and an asymmetric condition on the rest."""
    side = lambda p: _t(spark, sf_dir, "nation").select(F.col("n_name").alias(p), "n_regionkey")
    return side("a").join(side("b"), "n_regionkey").filter(F.struct(F.length("a"), "a") < F.struct(F.length("b"), "b")).select("a", "b")


@query()
def unrelated_documents(spark, sf_dir):
    """Documents that no cluster could hold: representatives without a pair at the threshold."""
    docs = _docs(spark, sf_dir)
    strong = relate.pair_scores(docs, corpus.THRESHOLD).filter(F.col("score") >= corpus.THRESHOLD)
    tied = strong.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    return relate.classes(docs).join(tied, "rep", "left_anti").select("doc_id", "rep")
