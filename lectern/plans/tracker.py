"""Queries of session figures, of reports written in registered SQL functions, and of orders by language."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import forms, sql
from lectern.operators import commands, tracker
from lectern.plans.catalog import query
from lectern.plans.commands import _SQL, _candidates, _context, _done, _t
from lectern.sources import reports
from lectern.sources.shared import written


def _covered(spark, sf_dir, c):
    """Lines of a candidate's order as its occurrences."""
    n = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return c.select("o_orderkey", "session_id", "candidate_id").join(n, "o_orderkey", "left").select("session_id", "candidate_id", F.coalesce("n", F.lit(0)).alias("n"))


def _figures(spark, sf_dir, c, covered):
    done, _ = written(_done(spark, sf_dir, _context(c)))  # read for gestures, results, decisions and pace
    times = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.timestamp_micros(F.col("event_id") * 100_000).alias("ts"))
    now, _ = written(commands.decisions(done))  # read for gestures, what is covered and counts
    return done, now, tracker.figures(done, covered, now.select("session_id", "candidate_id"), times)


_BATCH = "('" + "', '".join(tracker.BATCHES) + "')"
_FIGURES = f"""{_SQL}, last AS (SELECT session_id, id, arg_max({{'w': write, 'd': decision}}, (seq, item)) AS x FROM applied GROUP BY 1, 2), now AS (SELECT session_id, id, x.d AS decision FROM last WHERE x.w <> 'reset'),
n AS (SELECT session_id, candidate_id AS id, count(l_orderkey) AS n FROM (SELECT o_orderkey, o_custkey::VARCHAR AS session_id, o_custkey || ':' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS candidate_id FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
cover AS (SELECT session_id, sum(n)::BIGINT AS covered FROM now JOIN n USING (session_id, id) GROUP BY 1), firsts AS (SELECT session_id, id, min(seq) AS g FROM applied JOIN now USING (session_id, id) WHERE write <> 'reset' GROUP BY 1, 2),
made AS (SELECT session_id, count(DISTINCT g) AS made FROM firsts GROUP BY 1),
gaps AS (SELECT session_id, (seq - lag(seq) OVER (PARTITION BY session_id ORDER BY seq)) / 10.0::DOUBLE AS gap FROM applied WHERE write = 'set' AND type NOT IN {_BATCH}),
pace AS (SELECT session_id, median(gap) AS pace FROM gaps WHERE gap > 0 AND gap <= 120 GROUP BY 1 HAVING count(*) >= 3),
f AS (SELECT session_id, coalesce(made, 0) AS made, coalesce(covered, 0) AS covered, greatest(coalesce(covered, 0) - coalesce(made, 0), 0) AS avoided, pace FROM (SELECT DISTINCT session_id FROM heads) LEFT JOIN made USING (session_id) LEFT JOIN cover USING (session_id) LEFT JOIN pace USING (session_id)),
t AS (SELECT *, avoided * pace AS total, [floor(total / 60 * 10 + 0.5) / 10, floor(total / 3600 * 10 + 0.5) / 10, floor(total / 86400 * 10 + 0.5) / 10] AS v FROM f)"""


@query(f"""{_FIGURES} SELECT session_id, made, covered, avoided, CASE WHEN covered > 0 THEN 100.0::DOUBLE * avoided / covered ELSE 0 END AS percent, pace,
  CASE WHEN avoided > 0 AND pace IS NOT NULL THEN CASE WHEN v[1] < 60 THEN v[1] WHEN v[2] < 24 THEN v[2] ELSE v[3] END END AS saved, CASE WHEN avoided > 0 AND pace IS NOT NULL THEN CASE WHEN v[1] < 60 THEN 'minutes' WHEN v[2] < 24 THEN 'hours' ELSE 'days' END END AS unit FROM t""")
def decision_tracker(spark, sf_dir):
    """Gestures, occurrences covered and avoided, and time, for every session of commands."""
    c = _candidates(spark, sf_dir)
    return _figures(spark, sf_dir, c, _covered(spark, sf_dir, c))[-1]


@query(f"""{_FIGURES}, size AS (SELECT session_id, count(*) AS items, sum(n)::BIGINT AS occurrences FROM n GROUP BY 1), c AS (SELECT session_id, count(*) FILTER (decision = 'Rename') AS change_count, count(*) FILTER (decision = 'Ignore') AS ignore_count, count(*) FILTER (decision = 'Keep') AS keep_count,
  count(*) FILTER (decision = 'Redact') AS redact_count, count(*) AS decided FROM now GROUP BY 1)
SELECT session_id, coalesce(change_count, 0) AS change_count, coalesce(ignore_count, 0) AS ignore_count, coalesce(keep_count, 0) AS keep_count, coalesce(redact_count, 0) AS redact_count, made AS decisions_made, avoided AS decisions_avoided,
  items AS review_item_count, occurrences AS occurrence_count, CASE WHEN coalesce(decided, 0) >= items THEN 'completed' ELSE 'incomplete' END AS completion_status FROM f JOIN size USING (session_id) LEFT JOIN c USING (session_id)""")
def usage_payloads(spark, sf_dir):
    """The usage report that each session of commands sends."""
    c = _candidates(spark, sf_dir)
    covered, _ = written(_covered(spark, sf_dir, c))  # read for what is covered and for sizes
    done, now, found = _figures(spark, sf_dir, c, covered)
    sizes = covered.groupBy("session_id").agg(F.count("*").alias("items"), F.sum("n").alias("occurrences"))
    return tracker.payloads(done, sizes, found, now)


_USAGE = """count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_purchases, round(count(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / count(*), 1) AS purchase_percent, count(DISTINCT ts::DATE) AS active_days"""


@query(f"""SELECT 'all' AS scope, NULL::BIGINT AS user_id, {_USAGE}, NULL::DATE AS last_day FROM events UNION ALL
SELECT 'user', user_id, {_USAGE}, max(ts::DATE) FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY user_id""")
def sql_usage_report(spark, sf_dir):
    """A report that is written in the registered SQL functions alone."""
    _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).createOrReplaceTempView(sql.VIEWS)
    sql.register(spark)
    return spark.sql("""
        SELECT 'all' AS scope, CAST(NULL AS BIGINT) AS user_id, n_events, n_purchases, purchase_percent, active_days, CAST(NULL AS DATE) AS last_day FROM usage_summary(NULL, NULL)
        UNION ALL SELECT 'user', user_id, n_events, n_purchases, purchase_percent, active_days, last_day FROM usage_of_users(TIMESTAMP '2024-01-03 00:00:00', NULL)""")


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS word FROM documents)
SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY icu_sort_key(word, 'en'), word)::INT AS place, row_number() OVER (PARTITION BY doc_id ORDER BY encode(word))::INT AS binary_place FROM w""")
def collated_words(spark, sf_dir):
    """Words of each document in the order of a language, beside that of their bytes."""
    words = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]+"), F.lit(0)))).alias("word"))
    words = words.repartition("doc_id").distinct()  # dealt as the orders need it, so that words are shuffled once
    place = lambda *order: F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return words.select("doc_id", "word", place(*forms.collated("word")).alias("place"), place("word").alias("binary_place"))


@query(f"""{_SQL}, last AS (SELECT session_id, id AS candidate_id, arg_max({{'w': write, 'd': decision}}, (seq, item)) AS x FROM applied GROUP BY 1, 2), now AS (SELECT session_id, candidate_id, x.d AS decision FROM last WHERE x.w <> 'reset'),
stamps AS (SELECT session_id, group_id, arg_max(CASE type WHEN 'flattenGroup' THEN 'Refined' WHEN 'completeNotQuite' THEN 'Refined' ELSE 'Confirmed' END, seq) AS stamp FROM outcome JOIN (SELECT session_id, seq, group_id FROM heads) USING (session_id, seq)
  WHERE reason IS NULL AND (type IN {tuple(commands.GROUP)} OR type = 'completeNotQuite') GROUP BY 1, 2),
c AS (SELECT c.session_id, candidate_id, coalesce(decision, 'Undecided') AS decision, decision IS NOT NULL OR stamp IS NOT NULL AS resolved FROM cand c LEFT JOIN now USING (session_id, candidate_id) LEFT JOIN stamps USING (session_id, group_id)),
l AS (SELECT session_id, count(*) AS total, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (decision = 'Keep') AS keep, count(*) FILTER (decision = 'Rename') AS rename, count(*) FILTER (decision = 'Redact') AS redact, count(*) FILTER (decision = 'Ignore') AS ignore,
  count(*) FILTER (decision = 'Undecided') AS undecided, min(candidate_id) AS first_candidate, arg_min(decision, candidate_id) AS first_decision FROM c GROUP BY 1),
g AS (SELECT session_id, count(*) AS n_groups, count(stamp) AS groups_decided FROM grp LEFT JOIN stamps USING (session_id, group_id) GROUP BY 1)
SELECT c_custkey::VARCHAR AS session_id, coalesce(total, 0) AS total, coalesce(keep, 0) AS keep, coalesce(rename, 0) AS rename, coalesce(redact, 0) AS redact, coalesce(ignore, 0) AS ignore, coalesce(undecided, 0) AS undecided, coalesce(unresolved, 0) AS unresolved,
  coalesce(groups_decided, 0) AS groups_decided, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS passed, c_custkey % 5 = 2 AS mismatched, c_custkey % 5 = 0 AS ready, coalesce(unresolved, 0) > 0 OR c_custkey % 5 <> 0 AS outstanding, first_candidate, first_decision, coalesce(n_groups, 0)::INT AS n_groups
FROM customer LEFT JOIN l ON l.session_id = c_custkey::VARCHAR LEFT JOIN g ON g.session_id = c_custkey::VARCHAR""")
def audit_reports(spark, sf_dir):
    """The complete report of every customer's session of commands; first candidate and groups are read back from its JSON."""
    known, groups, options = _context(_candidates(spark, sf_dir))
    done, _ = written(_done(spark, sf_dir, (known, groups, options)))
    c, id_ = _t(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    sessions = c.select(id_.alias("session_id"), F.concat(F.lit("doc"), id_).alias("doc_id"), F.col("c_name").alias("file_name"), F.lit("2026-01-01").alias("created_at"), F.lit("2026-02-01").alias("updated_at"))
    checks = c.filter("c_custkey % 5 < 3").select(id_.alias("session_id"), F.concat(F.when(F.col("c_custkey") % 5 == 2, "other").otherwise("doc"), id_).alias("doc_id"), (F.col("c_custkey") % 5 == 0).alias("passed"), F.lit(0).alias("problems"))
    shown = known.select("session_id", "candidate_id", F.lit("order").alias("detected_type"), F.col("candidate_id").alias("display_value"), F.lit(1).alias("n_occurrences"))
    found = reports.audit_report(sessions, shown, commands.decisions(done), groups, commands.group_decisions(done), commands.links(done), checks)
    read = F.from_json("report", "candidates array<struct<candidate_id:string,decision:string>>, groups array<struct<group_id:string>>")
    return found.withColumn("read", read).withColumn("first", F.get("read.candidates", F.lit(0))).select(
        "session_id", "total", "keep", "rename", "redact", "ignore", "undecided", "unresolved", "groups_decided", "passed", "mismatched", "ready", "outstanding", F.col("first.candidate_id").alias("first_candidate"), F.col("first.decision").alias("first_decision"), F.size("read.groups").alias("n_groups"),
    )
