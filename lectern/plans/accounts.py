"""Account reports, over the star: customers are users, nations organizations, orders documents with their lines as pages."""

from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators import accounts
from lectern.plans.catalog import query

AS_OF = datetime(1998, 7, 15, 12)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _usage(spark, sf_dir):
    pages = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("page_count"), F.sum("l_linenumber").alias("decisions_made"), F.sum(F.floor("l_quantity")).alias("decisions_avoided"), F.max("l_shipdate").alias("done")
    )
    users = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"))
    rows = _t(spark, sf_dir, "orders").join(pages, F.col("o_orderkey") == F.col("l_orderkey")).withColumnRenamed("o_custkey", "user_id").join(users, "user_id")
    start, done = F.col("o_orderdate").cast("timestamp"), F.col("done").cast("timestamp")
    over = F.col("o_orderstatus") == "F"
    return rows.select(
        F.col("o_orderkey").alias("id"), "user_id", "organization_id", F.when(over, "completed").when(F.col("o_orderstatus") == "P", "incomplete").otherwise("started").alias("status"),
        "page_count", "decisions_made", "decisions_avoided", start.alias("started_at"), F.when(over, done).alias("completed_at"), F.greatest(start, done).alias("updated_at"),
    )


def _profiles(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"))


def _organizations(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("name"))


def _members(spark, sf_dir):
    role = F.when(F.col("c_acctbal") > 9800, "owner").when(F.col("c_acctbal") > 7000, "admin").otherwise("member")
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("organization_id"), F.col("c_custkey").alias("user_id"), role.alias("role"))


def _micros(df, *names):
    return df.select([F.unix_micros(c).alias(f"{c}_us") if c in names else F.col(c) for c in df.columns])


_USAGE = """u AS (SELECT o_orderkey AS id, o_custkey AS user_id, c_nationkey AS organization_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'incomplete' ELSE 'started' END AS status, n AS page_count, made AS decisions_made, avoided AS decisions_avoided,
  o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN done END AS completed_at, greatest(o_orderdate, done) AS updated_at
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS made, sum(floor(l_quantity)::BIGINT)::BIGINT AS avoided, max(l_shipdate) AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey)"""
_SEC = "CASE WHEN status = 'completed' AND completed_at IS NOT NULL THEN (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 END"
_MEMBERS = "m AS (SELECT c_nationkey AS organization_id, c_custkey AS user_id, CASE WHEN c_acctbal > 9800 THEN 'owner' WHEN c_acctbal > 7000 THEN 'admin' ELSE 'member' END AS role FROM customer)"
_NOW = "TIMESTAMP '1998-07-15 12:00:00'"


@query(f"""
WITH {_USAGE}, s AS (SELECT count(*) AS started, count(*) FILTER (status = 'completed') AS completed, coalesce(sum(page_count), 0)::BIGINT AS page_count,
  coalesce(sum(decisions_made), 0)::BIGINT AS decisions_made, coalesce(sum(decisions_avoided), 0)::BIGINT AS decisions_avoided,
  count(*) FILTER (started_at >= date_trunc('day', {_NOW})) AS documents_day, count(*) FILTER (started_at >= date_trunc('week', {_NOW})) AS documents_week,
  count(*) FILTER (started_at >= date_trunc('month', {_NOW})) AS documents_month, count(DISTINCT user_id) FILTER (started_at >= date_trunc('day', {_NOW})) AS users_day,
  count(DISTINCT user_id) FILTER (started_at >= date_trunc('week', {_NOW})) AS users_week, count(DISTINCT user_id) FILTER (started_at >= date_trunc('month', {_NOW})) AS users_month,
  count(DISTINCT user_id) AS active_users, epoch_us(max(updated_at)) AS last_activity_us, round(avg({_SEC}))::BIGINT AS mean_seconds FROM u)
SELECT *, round(decisions_avoided * 100.0::DOUBLE / nullif(decisions_made + decisions_avoided, 0), 1) AS avoided_percent, round(completed * 100.0::DOUBLE / nullif(started, 0), 1) AS completion_rate,
  round(started * 1.0::DOUBLE / nullif(active_users, 0), 1) AS documents_per_user, round(decisions_made * 1.0::DOUBLE / nullif(completed, 0), 1) AS decisions_per_document FROM s
""")
def usage_summary(spark, sf_dir):
    return _micros(accounts.summary(_usage(spark, sf_dir), AS_OF), "last_activity")


_SUMS = f"""count(id) AS started, count(*) FILTER (status = 'completed') AS completed, {{more}}coalesce(sum(page_count), 0)::BIGINT AS page_count,
  coalesce(sum(decisions_made), 0)::BIGINT AS decisions_made, coalesce(sum(decisions_avoided), 0)::BIGINT AS decisions_avoided, round(avg({_SEC}))::BIGINT AS mean_seconds, epoch_us(max(updated_at)) AS last_activity_us"""


@query(f"""
WITH {_USAGE} SELECT c_custkey AS user_id, c_name AS name, {_SUMS.format(more="count(*) FILTER (status IN ('started', 'incomplete')) AS incomplete, ")},
  count(DISTINCT date_trunc('day', started_at)) AS active_days, epoch_us(min(started_at)) AS first_activity_us FROM customer LEFT JOIN u ON u.user_id = c_custkey GROUP BY 1, 2
""")
def account_users(spark, sf_dir):
    return _micros(accounts.by_user(_profiles(spark, sf_dir), _usage(spark, sf_dir)), "first_activity", "last_activity")


@query(f"""
WITH {_USAGE}, {_MEMBERS} SELECT n_nationkey AS organization_id, n_name AS name, count(DISTINCT m.user_id) AS members, count(DISTINCT u.user_id) AS active_users, {_SUMS.format(more="")}
FROM nation LEFT JOIN m ON m.organization_id = n_nationkey LEFT JOIN u ON u.organization_id = n_nationkey GROUP BY 1, 2
""")
def account_organizations_as_joined(spark, sf_dir):
    """Documents counted once for every member, as by a join of both."""
    return _micros(accounts.by_organization(_organizations(spark, sf_dir), _members(spark, sf_dir), _usage(spark, sf_dir), once=False), "last_activity")


@query(f"""
WITH {_USAGE}, {_MEMBERS}, c AS (SELECT organization_id AS o, count(DISTINCT user_id) AS members FROM m GROUP BY 1)
SELECT n_nationkey AS organization_id, n_name AS name, coalesce(any_value(members), 0) AS members, count(DISTINCT u.user_id) AS active_users, {_SUMS.format(more="")}
FROM nation LEFT JOIN c ON o = n_nationkey LEFT JOIN u ON u.organization_id = n_nationkey GROUP BY 1, 2
""")
def account_organizations(spark, sf_dir):
    return _micros(accounts.by_organization(_organizations(spark, sf_dir), _members(spark, sf_dir), _usage(spark, sf_dir)), "last_activity")


@query(f"""
WITH {_USAGE} SELECT id, unnest(['completed before started', 'updated before started', 'status and completion differ', 'started in the future']) AS rule FROM u WHERE false
UNION ALL SELECT id, 'completed before started' FROM u WHERE completed_at < started_at UNION ALL SELECT id, 'updated before started' FROM u WHERE updated_at < started_at
UNION ALL SELECT id, 'status and completion differ' FROM u WHERE (status = 'completed') <> (completed_at IS NOT NULL) UNION ALL SELECT id, 'started in the future' FROM u WHERE started_at > {_NOW}
""")
def usage_rules_broken(spark, sf_dir):
    return accounts.broken(_usage(spark, sf_dir), AS_OF)


@query(f"""
WITH {_USAGE}, {_MEMBERS} SELECT id, user_id FROM u WHERE user_id = 7 OR organization_id IN (SELECT organization_id FROM m WHERE user_id = 7 AND role IN ('owner', 'admin'))
""")
def usage_visible(spark, sf_dir):
    """What user 7 may see."""
    return accounts.visible(_usage(spark, sf_dir), _members(spark, sf_dir), 7).select("id", "user_id")


@query(f"""
WITH {_MEMBERS}, n AS (SELECT organization_id, count(*) AS n FROM m WHERE role = 'owner' GROUP BY 1)
SELECT user_id AS change_id, organization_id, user_id, NULL::VARCHAR AS next_role FROM m LEFT JOIN n USING (organization_id) WHERE coalesce(n, 0) - (role = 'owner')::INT = 0
""")
def owner_guard(spark, sf_dir):
    """Members whose removal would leave an organization without an owner."""
    members = _members(spark, sf_dir)
    return accounts.without_owner(members, members.select(F.col("user_id").alias("change_id"), "organization_id", "user_id", F.lit(None).cast("string").alias("next_role")))


@query("""
WITH e AS (SELECT r_regionkey AS organization_id, n_nationkey AS position, CASE WHEN n_nationkey % 4 = 0 THEN ' ' || n_name || '@Example.org' WHEN n_nationkey % 4 = 1 THEN 'team@example.org' WHEN n_nationkey % 4 = 2 THEN n_name ELSE '' END AS raw, n_name AS name
  FROM nation JOIN region ON n_regionkey = r_regionkey), f AS (SELECT organization_id, position, lower(trim(raw)) AS email FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY organization_id, email ORDER BY position) AS nth FROM f)
SELECT organization_id, position, email, CASE WHEN email = '' THEN 'no address' WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'bad address' ELSE 'repeated address' END AS problem FROM g
WHERE email = '' OR NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') OR nth > 1
""")
def pending_member_errors(spark, sf_dir):
    n = F.col("n_nationkey") % 4
    raw = F.when(n == 0, F.concat(F.lit(" "), "n_name", F.lit("@Example.org"))).when(n == 1, "team@example.org").when(n == 2, F.col("n_name")).otherwise("")
    rows = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("organization_id"), F.col("n_nationkey").alias("position"), raw.alias("email"), F.col("n_name").alias("name"))
    return accounts.pending_errors(rows)
