"""Queries of the command fold: events stand for the commands of a user, whose orders are the candidates and their priorities the groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import commands
from lectern.plans.catalog import query
from lectern.sources.shared import scratch, written
from lectern.streaming import commands as streamed

_KINDS = [*commands.SINGLE, *commands.GROUP, *commands.OPENED, commands.IMPORT, commands.BULK, commands.RESET, commands.LINK, commands.ACCEPTED, commands.DISMISS, commands.RESTORE]


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _commands(events):
    r, e, k = F.floor("value") % 14 + 1, F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), ((k + e) % len(_KINDS) + 1).cast("int"))
    id_ = lambda n: F.concat(F.col("user_id").cast("string"), F.lit(":"), (r + n).cast("string"))
    put = lambda n, decision, text: F.struct(id_(n).alias("candidate_id"), F.lit(decision).alias("decision"), text.alias("replacement"))
    pick = F.element_at(F.array(*map(F.lit, ["Keep", "Rename", "Redact", "Ignore"])), (e % F.when(F.col("type") == commands.MEMBER, 3).otherwise(4) + 1).cast("int"))
    return events.withColumn("type", kind).select(
        F.col("user_id").cast("string").alias("session_id"), e.alias("seq"), "type", id_(0).alias("candidate_id"),
        F.when(k % 10 == 0, "p9").otherwise(F.concat(F.lit("p"), (r % 3 + 1).cast("string"))).alias("group_id"), pick.alias("decision"),
        F.when(e % 5 == 0, F.lit(None)).when(e % 5 == 1, "  ").otherwise(F.concat(F.lit(" R"), r.cast("string"), F.lit(" "))).alias("replacement"),
        F.when(e % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(id_(0), id_(1), id_(0))).alias("candidate_ids"),
        F.array(put(0, "Keep", F.lit(None).cast("string")), put(2, "Rename", F.concat(F.lit("N"), r.cast("string")))).alias("proposals"),
        F.concat(F.lit("x"), (r % 3).cast("string")).alias("proposal_id"), F.when(e % 2 == 0, F.array(id_(0))).alias("reset_ids"),
    )


def _candidates(spark, sf_dir):
    """Orders as the candidates of their customer's session; written, as much is derived from them."""
    c = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"), "o_orderkey", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("group_id"),
        F.when(F.col("o_orderpriority").startswith("3"), " ").otherwise(F.col("o_orderpriority")).alias("canonical_name"), "o_totalprice",
    )
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("o_orderkey")))
    return written(c.withColumn("candidate_id", F.concat("session_id", F.lit(":"), F.col("rank").cast("string"))))[0]


def _context(c):
    groups = c.groupBy("session_id", "group_id").agg(F.min("canonical_name").alias("canonical_name"), F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))).alias("m"))
    groups = groups.withColumn("members", F.transform("m", lambda x: x["candidate_id"])).drop("m")
    groups, _ = written(groups)  # read for commands and for options
    of = groups.groupBy("session_id").agg(F.collect_list("group_id").alias("group_ids"))
    return c.select("session_id", "candidate_id"), groups, c.filter("o_totalprice > 250000").select("session_id", "candidate_id").join(of, "session_id")


def _done(spark, sf_dir, context=None):
    return commands.writes(commands.expanded(_commands(_t(spark, sf_dir, "events")), *(context or _context(_candidates(spark, sf_dir)))))


_LIST = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
_G, _O = _LIST(commands.GROUP), _LIST(commands.OPENED)
_ONE = _LIST([*commands.SINGLE, commands.MEMBER, commands.LINK])
_SQL = f"""
WITH RECURSIVE cand AS (
  SELECT o_custkey::VARCHAR AS session_id, o_custkey || ':' || row_number() OVER w AS candidate_id, row_number() OVER w AS rank, 'p' || o_orderpriority[1] AS group_id,
    CASE WHEN o_orderpriority LIKE '3%' THEN ' ' ELSE o_orderpriority END AS canonical_name, o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
grp AS (SELECT session_id, group_id, min(canonical_name) AS canonical_name, list(candidate_id ORDER BY rank) AS members FROM cand GROUP BY 1, 2),
opt AS (SELECT c.session_id, candidate_id, list(g.group_id) AS group_ids FROM cand c JOIN grp g USING (session_id) WHERE o_totalprice > 250000 GROUP BY 1, 2),
e AS (SELECT *, floor(value)::BIGINT % 14 + 1 AS r, (props->>'$.k')::BIGINT AS k, user_id || ':' AS u FROM events),
cmd AS (
  SELECT user_id::VARCHAR AS session_id, event_id AS seq, {_KINDS}[(k + event_id) % 19 + 1] AS type, u || r AS candidate_id, CASE WHEN k % 10 = 0 THEN 'p9' ELSE 'p' || (r % 3 + 1) END AS group_id,
    ['Keep', 'Rename', 'Redact', 'Ignore'][event_id % CASE WHEN type = '{commands.MEMBER}' THEN 3 ELSE 4 END + 1] AS decision, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' R' || r || ' ' END AS replacement,
    CASE WHEN event_id % 7 = 0 THEN [] ELSE [u || r, u || (r + 1), u || r] END AS candidate_ids, [u || r, u || (r + 2)] AS proposed, 'x' || (r % 3) AS proposal_id, CASE WHEN event_id % 2 = 0 THEN [u || r] END AS reset_ids, r
  FROM e),
cx AS (
  SELECT c.*, members, trim(g.canonical_name) AS flat, g.group_id IS NOT NULL AS has_group, group_ids, trim(replacement) AS txt,
    CASE WHEN type IN ('keepCandidate', 'confirmGroup', '{commands.LINK}') THEN 'Keep' WHEN type IN ('renameCandidate', 'flattenGroup') THEN 'Rename' WHEN type IN ('redactCandidate', 'redactGroup') THEN 'Redact'
      WHEN type IN ('ignoreCandidate', 'ignoreGroup') THEN 'Ignore' ELSE c.decision END AS wants, known IS NOT NULL AS here
  FROM cmd c LEFT JOIN grp g USING (session_id, group_id) LEFT JOIN opt o USING (session_id, candidate_id) LEFT JOIN (SELECT session_id, candidate_id, true AS known FROM cand) k USING (session_id, candidate_id)),
heads AS (
  SELECT *, CASE WHEN type IN {_ONE} THEN [candidate_id] WHEN type IN {_G} THEN members WHEN type IN ('{commands.BULK}', '{commands.RESET}') THEN candidate_ids WHEN type = '{commands.RESTORE}' THEN reset_ids WHEN type = '{commands.IMPORT}' THEN proposed END AS ids,
    CASE WHEN (type IN {_G} OR type = 'enterNotQuite') AND NOT has_group THEN 'no such entity group: ' || group_id WHEN len(candidate_ids) > 0 THEN NULL WHEN type = '{commands.BULK}' THEN '{commands.NO_BULK}'
      WHEN type = '{commands.RESET}' THEN '{commands.NO_RESET}' WHEN type = '{commands.DISMISS}' THEN '{commands.NO_DISMISS}' WHEN type = '{commands.RESTORE}' THEN '{commands.NO_RESTORE}' END AS fault,
    CASE WHEN type = '{commands.MEMBER}' AND NOT coalesce(list_contains(members, candidate_id), false) THEN candidate_id || ' is not a member of Not Quite group ' || group_id
      WHEN type IN {_ONE} AND NOT here THEN 'no such candidate: ' || candidate_id WHEN type = '{commands.LINK}' AND group_ids IS NULL THEN candidate_id || ' is not a currently-proposed ambiguity'
      WHEN type = '{commands.LINK}' AND NOT list_contains(group_ids, group_id) THEN group_id || ' is not one of ' || candidate_id || '''s proposed entity options'
      WHEN type = 'flattenGroup' THEN CASE WHEN coalesce(flat, '') = '' THEN 'group ' || group_id || '''s canonical name is blank; cannot flatten' END
      WHEN type NOT IN ('{commands.LINK}', '{commands.RESET}', '{commands.IMPORT}', '{commands.RESTORE}', '{commands.DISMISS}', '{commands.ACCEPTED}', 'enterNotQuite', 'exitNotQuite', 'completeNotQuite')
        AND (wants = 'Rename' AND coalesce(txt, '') = '' OR wants = 'Redact' AND txt = '') THEN '{commands.BLANK}' END AS late
  FROM cx),
ops AS (SELECT session_id, seq, type, group_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM heads WHERE fault IS NULL AND (type IN {_G} OR type IN {_O})),
walk AS (
  SELECT DISTINCT session_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS opened, NULL::VARCHAR AS stop FROM ops
  UNION ALL
  SELECT o.session_id, o.n, o.seq, CASE WHEN type = 'enterNotQuite' THEN coalesce(opened, group_id) WHEN type = 'exitNotQuite' AND opened = group_id THEN NULL ELSE opened END,
    CASE WHEN type = 'enterNotQuite' THEN CASE WHEN opened = group_id THEN '{commands.OPEN_HERE}' WHEN opened IS NOT NULL THEN '{commands.OPEN_THERE}' END
      WHEN type IN {_O} THEN CASE WHEN opened IS DISTINCT FROM group_id THEN 'no open Not Quite group matching ' || group_id END WHEN opened = group_id THEN '{commands.OPEN_BULK}' END
  FROM walk w JOIN ops o ON o.session_id = w.session_id AND o.n = w.n + 1),
marks AS (SELECT session_id, seq, type, lag(type) OVER (PARTITION BY session_id, proposal_id ORDER BY seq) AS before FROM heads WHERE fault IS NULL AND type IN ('{commands.DISMISS}', '{commands.RESTORE}')),
judged AS (
  SELECT h.*, coalesce(fault, stop, CASE WHEN m.type = '{commands.RESTORE}' AND before IS DISTINCT FROM '{commands.DISMISS}' THEN '{commands.NOT_DISMISSED}' END, late) AS why
  FROM heads h LEFT JOIN walk w USING (session_id, seq) LEFT JOIN marks m USING (session_id, seq)),
items AS (SELECT session_id, seq, type, why, wants, txt, flat, group_id, r, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS item FROM judged),
tried AS (
  SELECT i.*, CASE WHEN type IN ('{commands.RESET}', '{commands.RESTORE}') THEN 'reset' WHEN type = '{commands.IMPORT}' THEN 'import' ELSE 'set' END AS write
  FROM items i JOIN cand ON cand.session_id = i.session_id AND cand.candidate_id = id WHERE why IS NULL),
lagged AS (SELECT *, coalesce(lag(write) OVER (PARTITION BY session_id, id ORDER BY seq, item) <> 'reset', false) AS had FROM tried),
applied AS (
  SELECT session_id, seq, item, type, write, id, CASE WHEN write = 'import' THEN ['Keep', 'Rename'][item + 1] ELSE wants END AS decision,
    CASE WHEN write = 'import' THEN CASE item WHEN 1 THEN 'N' || r END WHEN type = 'flattenGroup' THEN flat WHEN wants IN ('Rename', 'Redact') THEN txt END AS replacement,
    CASE WHEN type IN {_G} OR type IN ('{commands.MEMBER}', '{commands.LINK}') THEN group_id ELSE id END AS anchor
  FROM lagged WHERE write = 'set' OR (write = 'import' AND NOT had) OR (write = 'reset' AND had)),
counted AS (
  SELECT j.session_id, j.seq, j.type, why, coalesce(len(ids), 0) AS n, count(a.seq) AS applied FROM judged j LEFT JOIN applied a ON a.session_id = j.session_id AND a.seq = j.seq GROUP BY ALL),
outcome AS (
  SELECT session_id, seq, type, applied, n, coalesce(why, CASE WHEN applied > 0 THEN NULL WHEN type = '{commands.BULK}' THEN '{commands.NONE_EXIST}' WHEN type = '{commands.RESET}' THEN '{commands.NONE_DECIDED}' END) AS reason FROM counted),
moves AS (
  SELECT session_id, seq, item, id, CASE WHEN write <> 'reset' AND decision <> 'Ignore' THEN anchor END AS joins, lag(joins) OVER (PARTITION BY session_id, id ORDER BY seq, item) AS leaves FROM applied)
"""
_RESULTS = "SELECT session_id, seq, type, reason IS NULL AS ok, reason, applied, CASE WHEN reason IS NULL THEN n - applied ELSE 0 END AS skipped FROM outcome"


@query(f"{_SQL} {_RESULTS}")
def review_command_results(spark, sf_dir):
    """What became of every command: all kinds, with the reasons of those that failed."""
    return commands.results(_done(spark, sf_dir))


@query(f"{_SQL} {_RESULTS}")
def review_command_stream(spark, sf_dir):
    """The same by the stream's keyed state, run over what is there."""
    streamed.with_state_store(spark)
    events = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, as a stream's plain path has to be a folder
    at = scratch(spark)
    run = streamed.fold(_commands(stream), *_context(_candidates(spark, sf_dir))).writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out", "parquet", "append")
    run.awaitTermination()
    return spark.read.schema(streamed.OUT).parquet(f"{at}/out").filter("item IS NULL").select("session_id", "seq", "type", "ok", "reason", "applied", "skipped")


@query(f"""{_SQL}, last AS (SELECT session_id, id AS candidate_id, arg_max({{'w': write, 'd': decision, 'r': replacement, 's': seq}}, (seq, item)) AS x FROM applied GROUP BY 1, 2)
SELECT session_id, candidate_id, x.d AS decision, x.r AS replacement, CASE x.w WHEN 'import' THEN 'imported' ELSE 'reviewer' END AS source, x.s AS seq FROM last WHERE x.w <> 'reset'""")
def review_decisions(spark, sf_dir):
    """The decision that every candidate has after all commands."""
    return commands.decisions(_done(spark, sf_dir))


@query(f"""{_SQL}, last AS (SELECT session_id, id, arg_max(joins, (seq, item)) FILTER (true) AS anchor, max((seq, item)) AS at, arg_max(coalesce(joins, ''), (seq, item)) AS now FROM moves GROUP BY 1, 2),
steps AS (SELECT session_id, seq, item, joins AS anchor, 1 AS step FROM moves WHERE joins IS DISTINCT FROM leaves AND joins IS NOT NULL UNION ALL SELECT session_id, seq, item, leaves, -1 FROM moves WHERE joins IS DISTINCT FROM leaves AND leaves IS NOT NULL),
sizes AS (SELECT *, sum(step) OVER (PARTITION BY session_id, anchor ORDER BY seq, item) AS members FROM steps),
minted AS (SELECT *, 'entity-' || row_number() OVER (PARTITION BY session_id ORDER BY seq, item) AS entity_id FROM sizes WHERE step = 1 AND members = 1),
current AS (SELECT session_id, anchor, arg_max(entity_id, (seq, item)) AS entity_id, arg_max(seq, (seq, item)) AS confirmed FROM minted GROUP BY 1, 2),
held AS (SELECT session_id, id, arg_max(coalesce(joins, ''), (seq, item)) AS anchor, max((seq, item)) FILTER (joins IS DISTINCT FROM leaves) AS since FROM moves GROUP BY 1, 2)
SELECT session_id, entity_id, anchor, string_agg(id, ',' ORDER BY since) AS members, any_value(confirmed) AS confirmed FROM held JOIN current USING (session_id, anchor) GROUP BY 1, 2, 3""")
def review_entities(spark, sf_dir):
    """The entities that the commands confirmed, with their members."""
    return commands.entities(_done(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(f"""{_SQL}, each AS (SELECT session_id, seq, item, CASE WHEN write = 'reset' THEN 'candidate-reset' ELSE 'candidate-decided' END AS kind FROM applied WHERE type <> '{commands.MEMBER}'
  UNION ALL SELECT session_id, seq, 999999, map({list(commands.CLOSING)}, {list(commands.CLOSING.values())})[type] FROM outcome WHERE reason IS NULL AND type NOT IN {_LIST(commands.SINGLE)}),
n AS (SELECT session_id, seq, kind, row_number() OVER (PARTITION BY session_id ORDER BY seq, item) AS number FROM each)
SELECT kind, count(*) AS n, max(number)::INT AS last_number, count(DISTINCT session_id) AS n_sessions FROM n GROUP BY 1""")
def review_event_kinds(spark, sf_dir):
    """The event log, counted by kind."""
    log = commands.events(_done(spark, sf_dir))
    return log.groupBy("kind").agg(F.count("*").alias("n"), F.max("number").alias("last_number"), F.count_distinct("session_id").alias("n_sessions"))


@query(f"""{_SQL} SELECT session_id, 'group' AS what, group_id AS id, arg_max(CASE type WHEN 'flattenGroup' THEN 'Refined' WHEN 'completeNotQuite' THEN 'Refined' ELSE 'Confirmed' END, seq) AS state, max(seq) AS seq
  FROM outcome JOIN (SELECT session_id, seq, group_id FROM heads) USING (session_id, seq) WHERE reason IS NULL AND (type IN {_G} OR type = 'completeNotQuite') GROUP BY 1, 3
UNION ALL SELECT session_id, 'dismissal', proposal_id, 'dismissed', max(seq) FROM outcome JOIN (SELECT session_id, seq, proposal_id FROM heads) USING (session_id, seq)
  WHERE reason IS NULL AND type IN ('{commands.DISMISS}', '{commands.RESTORE}') GROUP BY 1, 3 HAVING arg_max(type, seq) = '{commands.DISMISS}'
UNION ALL SELECT session_id, 'link', candidate_id, arg_max(group_id, seq), max(seq) FROM outcome JOIN (SELECT session_id, seq, candidate_id, group_id FROM heads) USING (session_id, seq) WHERE reason IS NULL AND type = '{commands.LINK}' GROUP BY 1, 3""")
def review_group_state(spark, sf_dir):
    """What groups, proposals and ambiguous candidates came to."""
    done = _done(spark, sf_dir)
    return (
        commands.group_decisions(done).select("session_id", F.lit("group").alias("what"), F.col("group_id").alias("id"), F.col("decision").alias("state"), "seq")
        .unionByName(commands.dismissals(done).select("session_id", F.lit("dismissal").alias("what"), F.col("proposal_id").alias("id"), F.lit("dismissed").alias("state"), "seq"))
        .unionByName(commands.links(done).select("session_id", F.lit("link").alias("what"), F.col("candidate_id").alias("id"), F.col("group_id").alias("state"), "seq"))
    )
