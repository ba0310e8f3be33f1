"""Queries over the event log."""

from pyspark.sql import functions as F

from lectern.operators import review
from lectern.plans.catalog import query
from lectern.streaming import activity


def _events(spark, sf_dir):
    return review.events(spark.read.parquet(f"{sf_dir}/events.parquet"))


_GAPS = """g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)"""


@query("""
SELECT user_id, event_type, arg_max(event_id, (epoch_us(ts), -event_id)) AS event_id, epoch_us(max(ts)) AS at_us FROM events GROUP BY 1, 2
""")
def decision_latest(spark, sf_dir):
    return review.latest(_events(spark, sf_dir)).select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("at_us"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total_value FROM events GROUP BY 1")
def decision_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total_value")
    )


@query(f"""
WITH {_GAPS} SELECT user_id, count(*) AS n_gaps, median(gap) AS median_gap FROM g WHERE gap > 0 AND gap <= 21600 GROUP BY 1 HAVING count(*) >= 3
""")
def activity_gaps_median(spark, sf_dir):
    return review.pace(_events(spark, sf_dir))


@query(f"""
WITH {_GAPS}, s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n_events, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us FROM s GROUP BY 1, 2
""")
def activity_sessions(spark, sf_dir):
    return review.sessions(_events(spark, sf_dir)).select(
        "user_id", "session", "n_events", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us")
    )


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, event_type, island::INT AS island, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY 1, 2, 3
""")
def contiguous_runs(spark, sf_dir):
    return review.runs(_events(spark, sf_dir))


@query("""
SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_purchase, round(sum(value), 4) AS total_value,
  count(DISTINCT date_trunc('day', ts)) AS active_days, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1
""")
def usage_by_user(spark, sf_dir):
    return review.usage_by_user(_events(spark, sf_dir)).withColumn("last_us", F.unix_micros("last_seen")).drop("last_seen")


@query("""
SELECT event_type, epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS n FROM events GROUP BY 1, 2
""")
def tumbling_counts(spark, sf_dir):
    return activity.tumbling(_events(spark, sf_dir)).select("event_type", F.unix_micros("window.start").alias("day_us"), "n")


@query("""
SELECT n_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS active, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def usage_by_organization(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.countDistinct("c_custkey").alias("active"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def top_orders(spark, sf_dir):
    """The report's top 100."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")
