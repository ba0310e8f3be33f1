"""Queries over figures of reviews; customers, orders and events stand for candidates, decisions and sessions."""

from pyspark.sql import functions as F

from lectern.operators import figures
from lectern.plans.catalog import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GROUPS = "groups AS (SELECT c_mktsegment AS doc_id, c_nationkey AS group_id, count(*) AS n_members, round(avg(c_acctbal))::INT % 50 AS confidence, right(min(c_name), 2) AS canonical_name FROM customer GROUP BY 1, 2)"


def _groups(spark, sf_dir):
    return _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("doc_id"), F.col("c_nationkey").alias("group_id")).agg(
        F.count("*").alias("n_members"), (F.round(F.avg("c_acctbal")).cast("int") % 50).alias("confidence"), F.substring(F.min("c_name"), -2, 2).alias("canonical_name")
    )


@query(f"WITH {_GROUPS} " + " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS name, group_id, row_number() OVER (PARTITION BY doc_id ORDER BY {first}, group_id) AS place FROM groups"
    for name, first in zip((*figures.GROUP_ORDERS, "list"), ("confidence DESC", "confidence", "n_members DESC", "n_members", "canonical_name", "n_members DESC, confidence DESC, canonical_name"), strict=True)
))
def group_orders(spark, sf_dir):
    """The places of the groups of each document (a segment of customers, its nations as groups) in every order."""
    from pyspark.sql import Window

    rows = _groups(spark, sf_dir)
    orders = {**{n: figures.group_order(n) for n in figures.GROUP_ORDERS}, "list": figures.group_list_order()}
    out = None
    for name, order in orders.items():
        one = rows.select("doc_id", F.lit(name).alias("name"), "group_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).alias("place"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""
WITH m AS (SELECT o_custkey AS unit, o_orderkey AS place, unnest([o_orderstatus, o_orderpriority]) AS member, unnest([1, 2]) AS i FROM orders),
f AS (SELECT unit, member, min(struct_pack(place := place, i := i)) AS first FROM m GROUP BY 1, 2)
SELECT unit, array_to_string(list(member ORDER BY first), '|') AS members FROM f GROUP BY 1
""")
def merged_units(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("place"), F.array("o_orderstatus", "o_orderpriority").alias("members"))
    return figures.merged_units(rows, "unit").withColumn("members", F.array_join("members", "|"))


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (value >= 100) AS n_large, round(sum(CASE WHEN value >= 100 THEN value ELSE 0 END), 2) AS large_value FROM events GROUP BY 1
""")
def event_tally(spark, sf_dir):
    return figures.tally(_t(spark, sf_dir, "events"), "event_type")


@query("""
WITH r AS (SELECT p_brand AS doc_id, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS display_value, p_size AS n, p_partkey % 97 AS score, p_type AS rule FROM part)
SELECT doc_id, lower(display_value) AS value, sum(n)::BIGINT AS n_occurrences, max(score) AS score, arg_max(display_value, struct_pack(a := score, b := n, c := display_value)) AS display_value,
  count(*) AS n_candidates, array_to_string(list_sort(list_distinct(list(rule))), ',') AS rules FROM r GROUP BY 1, 2
""")
def quality_roll_up(spark, sf_dir):
    value = F.when(F.col("p_size") % 2 == 0, F.upper(F.concat("p_name", F.lit("  ")))).otherwise(F.col("p_name"))
    rows = _t(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), F.rtrim(value).alias("display_value"), F.col("p_size").alias("n_occurrences"), (F.col("p_partkey") % 97).alias("score"), F.array("p_type").alias("rules")
    )
    return figures.rolled_up(rows).withColumn("rules", F.array_join("rules", ","))


@query("""
SELECT o_custkey, arg_min(o_orderpriority, struct_pack(a := CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '3-MEDIUM' THEN 1 ELSE 999 END, b := o_orderpriority)) AS rule FROM orders GROUP BY 1
""")
def primary_rules(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("rules"))
    return rows.select("o_custkey", figures.primary_rule(F.col("rules"), {"1-URGENT": 5, "3-MEDIUM": 1}).alias("rule"))


@query("""
WITH e AS (SELECT o_custkey, o_orderpriority AS d, max(o_totalprice) AS w FROM orders GROUP BY 1, 2)
SELECT o_custkey, array_to_string(list(d ORDER BY w DESC, d), '|') AS reasons, max(w) AS weight, array_to_string(list(d ORDER BY w DESC, d)[1:2], '|') AS top_two FROM e GROUP BY 1
""")
def reasons(spark, sf_dir):
    """Descriptions with their greatest weights, heaviest first, and the first two of them."""
    rows = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("description"), F.col("o_totalprice").alias("weight"))
    each = figures.strongest_reasons(rows, "o_custkey")
    pairs = rows.groupBy("o_custkey", "description").agg(F.max("weight").alias("weight")).groupBy("o_custkey").agg(F.collect_list(F.struct("weight", "description")).alias("all"))
    two = pairs.select("o_custkey", F.array_join(F.transform(figures.top(F.col("all"), 2), lambda x: x["description"]), "|").alias("top_two"))
    return each.join(two, "o_custkey").withColumn("reasons", F.array_join("reasons", "|"))


@query("""
WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey, round(done * 100.0 / n)::INT AS percent FROM s)
SELECT o_custkey, percent, CASE WHEN percent >= 100 THEN 'complete' WHEN percent > 0 THEN 'started' ELSE 'new' END AS state FROM p
""")
def completion(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("n"))
    return rows.select("o_custkey", figures.completion(F.col("done"), F.col("n")).alias("x")).select("o_custkey", "x.*")


@query("""
WITH g AS (SELECT event_type AS site, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0 AS gap FROM events)
SELECT site, count(*) AS n_writes, count(*) FILTER (gap >= 3600000) AS n_slow, max(gap) AS longest_ms FROM g GROUP BY 1
""")
def slow_seams(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("site", F.col("event_type"))
    return figures.slow_seams(rows, "user_id", 3_600_000)


def _facts(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    score = F.floor(F.abs("c_acctbal") / 100).cast("int")
    decision = F.element_at(F.array(F.lit("Keep"), F.lit("Ignore"), F.lit("Redact"), F.lit(None)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(
        F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("candidate_key"), F.col("c_mktsegment").alias("display_value"), F.lit("person").alias("detected_type"),
        (F.col("c_custkey") % 3).alias("n_occurrences"), score.alias("score"), score.alias("likelihood"), decision.alias("decision"), F.array("c_mktsegment").alias("categories"),
    ).withColumn("status", figures.status(F.col("decision"), F.col("candidate_key") % 10 == 7, F.col("score")))


_CUSTOMERS = """
facts AS (SELECT c_nationkey AS doc_id, c_custkey AS candidate_key, c_mktsegment AS display_value, c_custkey % 3 AS n_occurrences, floor(abs(c_acctbal) / 100)::INT AS score,
  (['Keep', 'Ignore', 'Redact', NULL])[c_custkey % 4 + 1] AS decision FROM customer),
told AS (SELECT *, CASE WHEN decision IS NOT NULL OR candidate_key % 10 = 7 THEN 'resolved' WHEN score < 25 THEN 'unlikely' ELSE 'to_review' END AS status FROM facts)
"""


@query(f"""WITH {_CUSTOMERS}
SELECT candidate_key, 'reviews' AS view FROM told WHERE status = 'to_review' AND n_occurrences > 1 UNION ALL
SELECT candidate_key, 'likely furniture' FROM told WHERE display_value = 'FURNITURE' AND score >= 90 UNION ALL
SELECT candidate_key, 'single' FROM told WHERE n_occurrences = 1
""")
def category_views(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    views = {
        "reviews": figures.narrowed(facts, "to_review", context="multiple-occurrences"), "likely furniture": figures.narrowed(facts, category="FURNITURE", context="high-likelihood"),
        "single": figures.narrowed(facts, context="single-occurrence"),
    }
    out = None
    for name, rows in views.items():
        one = rows.select("candidate_key", F.lit(name).alias("view"))
        out = one if out is None else out.unionAll(one)
    return out


@query(f"""WITH {_CUSTOMERS}
SELECT candidate_key, status, coalesce(decision = 'Keep', false) AS keep, coalesce(decision = 'Ignore', false) AS ignore, coalesce(decision = 'Redact', false) AS redact,
  CASE WHEN decision IS NOT NULL THEN 100 ELSE score END AS current, CASE WHEN decision IS NOT NULL AND score <> 100 THEN score END AS prior FROM told
""")
def wide_decisions(spark, sf_dir):
    """One column for each decision, where candidates stand, and their confidence as it is now."""
    rows = figures.wide(_facts(spark, sf_dir), "Keep", "Ignore", "Redact")
    return rows.withColumn("x", figures.live_confidence(F.col("score"), F.col("decision").isNotNull())).select("candidate_key", "status", "keep", "ignore", "redact", "x.current", "x.prior")


@query(f"""WITH {_CUSTOMERS}, s AS (SELECT *, CASE WHEN decision IS NOT NULL THEN 100 ELSE score END AS shown FROM told)
SELECT doc_id, round_even(0.65 * min(shown) + 0.35 * avg(shown), 0)::INT AS current, round_even(0.65 * min(score) + 0.35 * avg(score), 0)::INT AS prior, count(*) AS n_members FROM s GROUP BY 1
""")
def group_confidence(spark, sf_dir):
    return figures.group_confidence(_facts(spark, sf_dir).withColumn("decided", F.col("decision").isNotNull()), "doc_id")


@query(f"""WITH {_CUSTOMERS} SELECT display_value, 'person' AS detected_type, sum(n_occurrences)::BIGINT AS n_occurrences, count(DISTINCT doc_id) AS n_docs FROM told WHERE decision = 'Ignore' GROUP BY 1""")
def ignored_items(spark, sf_dir):
    return figures.ignored(_facts(spark, sf_dir))


@query(f"""WITH {_CUSTOMERS}, m AS (SELECT doc_id, lower(display_value) AS value, arg_max(decision, candidate_key) AS decision, max(candidate_key) AS "at" FROM told WHERE decision IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, 'person' AS detected_type, value, decision, "at" FROM m
""")
def decision_memory(spark, sf_dir):
    return figures.memory(_facts(spark, sf_dir).withColumn("at", F.col("candidate_key")))


@query("""
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'import' ELSE 'reviewer' END AS source FROM events),
g AS (SELECT user_id, bool_or(source = 'import') AS ever_imported, arg_max(source, struct_pack(a := ts, b := event_id)) AS last FROM e GROUP BY 1)
SELECT user_id, ever_imported, CASE WHEN NOT ever_imported THEN 'reviewer' WHEN last = 'import' THEN 'imported' ELSE 'imported-then-overridden' END AS provenance FROM g
""")
def provenance(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(
        "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "signup", "import").otherwise("reviewer").alias("source"), F.col("event_type").alias("decision")
    )
    return figures.provenance(rows, "user_id").select("user_id", "ever_imported", "provenance")


@query("""
WITH w AS (SELECT user_id, count(*)::DOUBLE AS events, sum(value) AS spent, count(DISTINCT event_type)::DOUBLE AS kinds FROM events GROUP BY 1)
SELECT user_id, 'activity' AS section, 'events' AS metric, events AS value FROM w UNION ALL SELECT user_id, 'activity', 'kinds', kinds FROM w UNION ALL SELECT user_id, 'money', 'spent', round(spent, 2) FROM w
""")
def metric_sections(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("spent"), F.countDistinct("event_type").alias("kinds"))
    return figures.long_form(rows, ["user_id"], {"activity": ["events", "kinds"], "money": ["spent"]})


@query("""
WITH singles AS (SELECT DISTINCT p_brand AS doc_id, string_split(p_name, ' ')[1] AS display_value FROM part WHERE p_size % 5 = 0),
words AS (SELECT p_brand AS doc_id, p_partkey, p_name, unnest(list_distinct(string_split(lower(p_name), ' '))) AS word FROM part WHERE p_size % 2 = 1)
SELECT s.doc_id, s.display_value, arg_min(p_name, p_partkey) AS witness, count(*) AS n_witnesses FROM singles s JOIN words w ON w.doc_id = s.doc_id AND w.word = lower(s.display_value) GROUP BY 1, 2
""")
def full_name_witnesses(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    singles = p.filter("p_size % 5 = 0").select(F.col("p_brand").alias("doc_id"), F.substring_index("p_name", " ", 1).alias("display_value")).distinct()
    names = p.filter("p_size % 2 = 1").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("sequence"), F.col("p_name").alias("display_value"))
    return figures.witnesses(singles, names)


@query("""
SELECT c_custkey AS candidate_key, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0) THEN 'group'
  WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 = 1) THEN 'ambiguous' ELSE 'remainder' END AS route FROM customer
""")
def resolution_routes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("candidate_key", F.col("o_custkey"))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_key"))
    return figures.routed(rows, o.filter("o_orderstatus = 'F' and o_orderkey % 4 = 0"), o.filter("o_orderstatus = 'O' and o_orderkey % 4 = 1"))


@query("""
SELECT coalesce(b.p_brand, a.p_brand) AS p_brand, coalesce(nb, 0) AS n_before, coalesce(na, 0) AS n_after, coalesce(nb, 0) - coalesce(na, 0) AS n_removed
FROM (SELECT p_brand, count(*) AS nb FROM part GROUP BY 1) b FULL JOIN (SELECT p_brand, count(*) AS na FROM part WHERE p_size > 20 GROUP BY 1) a ON a.p_brand = b.p_brand
""")
def cleanup_statistics(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return figures.before_and_after(p, p.filter("p_size > 20"), "p_brand")


@query("""
SELECT CASE WHEN p_size % 4 = 0 THEN '3' WHEN p_size % 4 = 1 THEN '1-2' WHEN p_size % 4 = 2 THEN '2-1' ELSE '1-1-1' END AS shape, count(*) AS n, count(*) FILTER (p_partkey % 3 = 0) AS n_accepted FROM part GROUP BY 1
""")
def split_shapes(spark, sf_dir):
    """Shapes of splits of three words, and how many of each were taken."""
    from lectern.functions import wording

    size = F.col("p_size") % 4
    cuts = F.when(size == 1, F.array(F.lit(0))).when(size == 2, F.array(F.lit(1))).when(size == 3, F.array(F.lit(1), F.lit(0), F.lit(7))).otherwise(F.expr("cast(array() as array<int>)"))
    return figures.split_shapes(_t(spark, sf_dir, "part").select(wording.parts_of(F.lit(3), cuts).alias("shape"), (F.col("p_partkey") % 3 == 0).alias("accepted")))


@query("""
WITH last AS (SELECT o_custkey, arg_max(struct_pack(s := o_orderstatus, d := o_orderdate), struct_pack(d := o_orderdate, s := o_orderstatus)) AS l FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT c_custkey AS session_id, c_nationkey AS owner, CASE WHEN l.s = 'F' THEN epoch_us(l.d) END AS archived_us FROM customer LEFT JOIN last ON o_custkey = c_custkey WHERE coalesce(l.s, '') <> 'P'
""")
def session_states(spark, sf_dir):
    """Sessions after archiving, restoring and deleting: the latest change of each counts."""
    sessions = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("owner"), F.lit(None).cast("timestamp").alias("archived_at"))
    action = F.when(F.col("o_orderstatus") == "F", "archive").when(F.col("o_orderstatus") == "P", "delete").otherwise("restore")
    # the order of actions at one time is that of the SQL's statuses: F, O, P
    changes = _t(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("at"), action.alias("action"))
    return figures.with_archived(sessions, changes).select("session_id", "owner", F.unix_micros("archived_at").alias("archived_us"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'artifact-focus' WHEN p_size % 3 = 0 THEN 'selection' WHEN p_size % 2 = 0 AND p_partkey % 4 <> 0 THEN 'item-focus' ELSE 'stage-remainder' END AS source,
  CASE WHEN p_size % 5 = 0 THEN 'artifact:' || p_brand WHEN p_size % 3 = 0 THEN 'item:' || p_type WHEN p_size % 2 = 0 AND p_partkey % 4 <> 0 THEN 'item:' || p_name ELSE 'item:a|item:b|artifact:c' END AS units FROM part
""")
def review_scopes(spark, sf_dir):
    size = F.col("p_size")
    none = F.expr("cast(array() as array<string>)")
    x = figures.scope(
        F.when(size % 5 == 0, F.col("p_brand")), F.when(size % 3 == 0, F.array("p_type")).otherwise(none), F.when(size % 2 == 0, F.col("p_name")), F.col("p_partkey") % 4 == 0,
        F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")),
    )
    return _t(spark, sf_dir, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.source", F.array_join("x.units", "|").alias("units"))
