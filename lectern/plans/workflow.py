"""Queries over decisions, queues and coverage; customers, orders and events stand for candidates and their decisions."""

from pyspark.sql import functions as F

from lectern.operators import review, workflow
from lectern.plans.catalog import query

_KINDS = {"click": "Keep", "view": "Ignore", "purchase": "Redact", "signup": "Rename"}


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _decision(kind):
    return F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), kind)


def _facts(spark, sf_dir):
    """Customers as candidates: the balance is the likelihood, the market segment a category, a nation a document."""
    c, likely = _t(spark, sf_dir, "customer"), F.floor(F.col("c_acctbal") / 100).cast("int")
    kind = F.when(F.col("c_custkey") % 3 == 0, "person").otherwise("email")
    decision = F.when(F.col("c_custkey") % 5 == 0, "Redact").when(F.col("c_custkey") % 5 == 1, "Keep")
    return c.select(
        F.col("c_nationkey").alias("doc_id"), F.concat(kind, F.lit(":"), F.lower("c_name")).alias("candidate_key"), F.col("c_name").alias("display_value"), kind.alias("detected_type"),
        (F.col("c_custkey") % 7).alias("n_occurrences"), F.when(likely >= 0, likely).alias("likelihood"), decision.alias("decision"), F.lit(None).cast("string").alias("replacement"),
        (F.col("c_custkey") % 11 == 0).alias("ambiguous"), F.array(F.lower("c_mktsegment")).alias("categories"), F.when(F.col("c_acctbal") < 0, "unlikely").otherwise("required").alias("necessity"),
    )


_FACTS = """f AS (SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'person' ELSE 'email' END AS detected_type, c_name AS display_value, c_custkey % 7 AS n_occurrences,
  CASE WHEN floor(c_acctbal / 100) >= 0 THEN floor(c_acctbal / 100)::INT END AS likelihood, CASE c_custkey % 5 WHEN 0 THEN 'Redact' WHEN 1 THEN 'Keep' END AS decision,
  c_custkey % 11 = 0 AS ambiguous, lower(c_mktsegment) AS category, c_acctbal < 0 AS unlikely FROM customer)"""


@query(f"""
WITH {_FACTS} SELECT doc_id, detected_type || ':' || lower(display_value) AS candidate_key FROM f WHERE NOT unlikely AND likelihood >= 90 AND detected_type = 'person'
  AND contains(lower(display_value || '  ' || detected_type || ' ' || coalesce(decision, 'unreviewed') || ' ' || likelihood || '%' || CASE WHEN ambiguous THEN ' ambiguous ambiguity' ELSE '' END || ' ' || category), 'unreviewed 9')
""")
def search_and_filter(spark, sf_dir):
    return workflow.shown(_facts(spark, sf_dir), " Unreviewed 9", ["high-confidence", "people"]).select("doc_id", "candidate_key")


@query(f"""
WITH {_FACTS}, g AS (SELECT *, detected_type || ':' || lower(display_value) AS candidate_key FROM f)
SELECT doc_id, candidate_key, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(likelihood, -1) DESC, candidate_key)::INT AS by_confidence,
  row_number() OVER (PARTITION BY doc_id ORDER BY n_occurrences DESC, candidate_key)::INT AS by_count, row_number() OVER (PARTITION BY doc_id ORDER BY decision IS NOT NULL, display_value, candidate_key)::INT AS by_state,
  row_number() OVER (PARTITION BY doc_id ORDER BY detected_type, display_value, candidate_key)::INT AS by_type FROM g
""")
def sort_orders(spark, sf_dir):
    """Places in four orders inside each document."""
    from pyspark.sql import Window

    place = lambda name: F.row_number().over(Window.partitionBy("doc_id").orderBy(*workflow.order(name)))
    return _facts(spark, sf_dir).select(
        "doc_id", "candidate_key", place("confidence-desc").alias("by_confidence"), place("occurrence-count-desc").alias("by_count"), place("review-state").alias("by_state"), place("entity-type").alias("by_type"),
    )


_D = "d AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'Keep' WHEN 'view' THEN 'Ignore' WHEN 'purchase' THEN 'Redact' WHEN 'signup' THEN 'Rename' END AS decision FROM events)"


@query(f"""
WITH {_D}, r AS (SELECT DISTINCT user_id, decision, list_position(['Redact', 'Rename', 'Keep', 'Ignore'], decision) AS r FROM d WHERE decision IS NOT NULL)
SELECT u.user_id, arg_min(decision, r) AS dominant, coalesce(array_to_string(list(decision ORDER BY r)[2:], ','), '') AS additional FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY 1
""")
def decision_precedence(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", _decision(F.col("event_type")).alias("decision"))
    return workflow.dominant(rows, "user_id").withColumn("additional", F.array_join("additional", ","))


@query(f"""
WITH {_D} SELECT user_id, CASE WHEN count(decision) = 0 THEN 'undecided' WHEN count(decision) = count(*) AND count(DISTINCT decision) = 1 THEN 'uniform' ELSE 'needs-attention' END AS state,
  count(*) AS n_members, count(decision) AS n_decided FROM d GROUP BY 1
""")
def group_decision_state(spark, sf_dir):
    return workflow.group_state(_t(spark, sf_dir, "events").select("user_id", _decision(F.col("event_type")).alias("decision")), "user_id")


_CREDIT = """e AS (SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'decided' WHEN 'purchase' THEN 'anchor' ELSE 'batched' END AS kind, floor(value)::BIGINT % 40 AS candidate FROM events)"""


@query(f"""
WITH {_CREDIT}, b AS (SELECT *, coalesce(min(CASE WHEN kind = 'anchor' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9223372036854775807) AS nxt FROM e),
g AS (SELECT session_id, candidate, CASE WHEN kind = 'decided' THEN seq ELSE nxt END AS t FROM b WHERE kind <> 'anchor' AND candidate < 30),
f AS (SELECT session_id, candidate, min(t) AS t FROM g GROUP BY 1, 2)
SELECT session_id, count(DISTINCT t) AS made FROM (SELECT DISTINCT session_id FROM e) s LEFT JOIN f USING (session_id) GROUP BY 1
""")
def batch_credit(spark, sf_dir):
    """Gestures of every user: clicks are single decisions, purchases end batches; candidates below 30 are resolved."""
    kind = F.when(F.col("event_type") == "click", "decided").when(F.col("event_type") == "purchase", "anchor").otherwise("batched")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.floor("value") % 40).alias("candidate_key"))
    return workflow.gestures(rows, rows.filter("candidate_key < 30"))


_PACE = """g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events),
p AS (SELECT user_id, count(*) AS n_gaps, median(gap) AS s FROM g WHERE gap > 0 AND gap <= 21600 GROUP BY 1 HAVING count(*) >= 3)"""


@query(f"""
WITH {_PACE}, t AS (SELECT user_id, n_gaps * s AS total FROM p)
SELECT user_id, CASE WHEN m < 60 THEN m WHEN h < 24 THEN h WHEN d < 7 THEN d WHEN w < 52 THEN w ELSE y END AS value, CASE WHEN m < 60 THEN 'minutes' WHEN h < 24 THEN 'hours' WHEN d < 7 THEN 'days' WHEN w < 52 THEN 'weeks' ELSE 'years' END AS unit
FROM (SELECT user_id, floor(total / 60 * 10 + 0.5) / 10 AS m, floor(total / 3600 * 10 + 0.5) / 10 AS h, floor(total / 86400 * 10 + 0.5) / 10 AS d, floor(total / 604800 * 10 + 0.5) / 10 AS w, floor(total / 31536000 * 10 + 0.5) / 10 AS y FROM t)
""")
def time_saved(spark, sf_dir):
    paced = review.pace(review.events(_t(spark, sf_dir, "events")))
    return paced.select("user_id", workflow.time_saved(F.col("n_gaps"), F.col("median_gap")).alias("t")).select("user_id", "t.value", "t.unit")


_CELLS = "c AS (SELECT user_id, event_id AS seq, event_type <> 'view' AND value > 3 AS resolved FROM events)"


def _cells(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), ((F.col("event_type") != "view") & (F.col("value") > 3)).alias("resolved"))


@query(f"""
WITH {_CELLS} SELECT user_id, seq, resolved, row_number() OVER (PARTITION BY user_id ORDER BY seq)::INT AS place,
  coalesce(sum((NOT resolved)::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS active FROM c
""")
def review_bands(spark, sf_dir):
    return workflow.zone(_cells(spark, sf_dir), "user_id", "compacting", 10)


@query(f"""
WITH {_CELLS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS rn FROM c),
r AS (SELECT *, bool_and(resolved) OVER (PARTITION BY user_id, rn // 3) AS retired FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY retired, rn)::INT AS place FROM r)
SELECT user_id, seq, resolved, place, NOT retired AND place <= 24 AS active FROM p
""")
def review_chunks(spark, sf_dir):
    return workflow.zone(_cells(spark, sf_dir), "user_id", "conveyor", 24, 3)


@query(f"""
WITH {_CELLS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY resolved, seq)::INT AS place FROM c) SELECT user_id, seq, resolved, place, NOT resolved AND place <= 24 AS active FROM p
""")
def review_rolling(spark, sf_dir):
    return workflow.zone(_cells(spark, sf_dir), "user_id", "rolling")


@query(f"""
WITH {_CELLS} SELECT user_id, seq, min(CASE WHEN NOT resolved THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open,
  max(CASE WHEN NOT resolved THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_open FROM c
""")
def queue_cursor(spark, sf_dir):
    return workflow.next_open(_cells(spark, sf_dir), "user_id").select("user_id", "seq", "next_open", "last_open")


@query("""
WITH o AS (SELECT l_suppkey AS doc_id, l_partkey AS candidate, l_orderkey * 10 + l_linenumber AS occurrence FROM lineitem),
k AS (SELECT DISTINCT doc_id, candidate FROM o WHERE candidate % 9 = 0 OR (candidate % 10 IN (2, 5) AND doc_id % 2 = 0)), s AS (SELECT DISTINCT occurrence FROM o WHERE occurrence % 13 = 0),
n AS (SELECT o.doc_id, o.candidate AS candidate_key, count(*) AS n_occurrences, sum((k.candidate IS NOT NULL OR s.occurrence IS NOT NULL)::INT)::BIGINT AS n_covered FROM o LEFT JOIN k ON k.doc_id = o.doc_id AND k.candidate = o.candidate LEFT JOIN s ON s.occurrence = o.occurrence GROUP BY 1, 2)
SELECT *, CASE WHEN n_covered = n_occurrences THEN 'resolved' WHEN n_covered > 0 THEN 'partial' ELSE 'unresolved' END AS status FROM n
""")
def coverage_partition(spark, sf_dir):
    """Lines as occurrences of parts in the document of a supplier: decisions on parts, on two groups of them, and on single lines."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("candidate_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occurrence_id"))
    none = F.lit(None).cast("long")
    decided = lines.filter("candidate_key % 9 = 0").select("doc_id", "candidate_key", none.alias("occurrence_id")).unionByName(lines.filter("occurrence_id % 13 = 0"))
    members = lines.select("doc_id", (F.col("candidate_key") % 10).alias("group_id"), "candidate_key").distinct()
    groups = members.filter("group_id in (2, 5) and doc_id % 2 = 0").select("doc_id", "group_id").distinct()
    return workflow.coverage(lines, decided, members, groups)


@query()
def decision_reuse(spark, sf_dir):
    """Names of parts and their types as candidates, decisions known for those of small parts."""
    parts = _t(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("doc_id"), F.concat(F.lit("person:"), "p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), F.col("p_size").cast("string")).alias("candidate_key"), "p_size", "p_brand")
    known = parts.filter("p_size <= 20").groupBy("candidate_key").agg(F.when(F.min("p_size") % 3 == 0, "Undecided").otherwise("Redact").alias("decision"), F.lit("").alias("replacement"))
    members = parts.select("doc_id", F.col("p_brand").alias("group_id"), "candidate_key").distinct()
    return workflow.reuse(parts, members, known)
