"""Functions for SQL users: scalar ones and parametrised tables, registered in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, and what follows it: parameters, result and body, all of it SQL.
SCALARS = {
    "guarded_percent": "(part DOUBLE, whole DOUBLE) RETURNS DOUBLE RETURN CASE WHEN whole IS NULL OR whole = 0 THEN NULL ELSE round(part * 100 / whole, 1) END",
    "day_of": "(at TIMESTAMP) RETURNS DATE RETURN to_date(at)",
    "in_range": "(at TIMESTAMP, since TIMESTAMP, until TIMESTAMP) RETURNS BOOLEAN RETURN (since IS NULL OR at >= since) AND (until IS NULL OR at < until)",
    "squeezed": r"(value STRING) RETURNS STRING RETURN trim(regexp_replace(value, '\\s+', ' '))",
    "name_order": "(value STRING) RETURNS STRING RETURN CASE WHEN squeezed(value) LIKE '%_,_%' AND trim(substring_index(squeezed(value), ',', 1)) <> '' THEN concat(trim(substr(squeezed(value), instr(squeezed(value), ',') + 1)), ' ', trim(substring_index(squeezed(value), ',', 1))) ELSE squeezed(value) END",
}
#: Tables read the view ``usage_events(user_id, event_type, value, ts)`` of the session.
TABLES = {
    "usage_summary": """(since TIMESTAMP, until TIMESTAMP) RETURNS TABLE (n_users BIGINT, n_events BIGINT, n_purchases BIGINT, purchase_percent DOUBLE, active_days BIGINT)
      RETURN SELECT count(DISTINCT user_id), count(*), count_if(event_type = 'purchase'), guarded_percent(count_if(event_type = 'purchase'), count(*)), count(DISTINCT day_of(ts)) FROM usage_events WHERE in_range(ts, since, until)""",
    "usage_of_users": """(since TIMESTAMP, until TIMESTAMP) RETURNS TABLE (user_id BIGINT, n_events BIGINT, n_purchases BIGINT, purchase_percent DOUBLE, active_days BIGINT, last_day DATE)
      RETURN SELECT user_id, count(*), count_if(event_type = 'purchase'), guarded_percent(count_if(event_type = 'purchase'), count(*)), count(DISTINCT day_of(ts)), max(day_of(ts)) FROM usage_events WHERE in_range(ts, since, until) GROUP BY user_id""",
}
VIEWS = "usage_events"


def register(spark: SparkSession, tables: bool = True) -> list[str]:
    """Registers all functions as temporary ones of the session, in place of earlier ones; tables need their view to exist.  Gives their names."""
    made = {**SCALARS, **(TABLES if tables else {})}
    for name, rest in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {rest}")
    return list(made)
