"""Usage reports over accounts, and the rules of membership.

Tables: ``profiles(user_id, name, admin)``, ``organizations(organization_id, name)``,
``members(organization_id, user_id, role, created_at)``, ``invitations(invitation_id,
organization_id, email, status, expires_at)`` and ``usage(id, user_id, organization_id,
status, page_count, decisions_made, decisions_avoided, started_at, completed_at, updated_at)``.
Reports take the present moment as a parameter, so that they can be repeated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles of members, and those that manage others.
ROLES, MANAGERS = ("owner", "admin", "member"), ("owner", "admin")
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
TOTALS = ("page_count", "decisions_made", "decisions_avoided")


def in_scope(usage: DataFrame, since: datetime | None = None, until: datetime | None = None, organization: int | None = None, user: int | None = None) -> DataFrame:
    """Usage rows of a period, organization or user; a parameter that is None adds no predicate, so all of them reach the scan."""
    for given, fits in (
        (since, lambda v: F.col("started_at") >= F.lit(v)), (until, lambda v: F.col("started_at") < F.lit(v)),
        (organization, lambda v: F.col("organization_id") == v), (user, lambda v: F.col("user_id") == v),
    ):
        usage = usage if given is None else usage.filter(fits(given))
    return usage


def _seconds() -> Column:
    spent = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return F.when((F.col("status") == "completed") & F.col("completed_at").isNotNull(), spent)


def _sums() -> list[Column]:
    return [
        F.count("id").alias("started"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status").isin("started", "incomplete")).alias("incomplete"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS],
        F.sum(_seconds()).alias("seconds"), F.count(_seconds()).alias("timed"), F.max("updated_at").alias("last_activity"),
    ]


def share(part: Column, whole: Column, scale: int = 100) -> Column:
    """``part / whole`` to one place, null if the whole is nothing."""
    return F.round(F.try_divide(part * F.lit(float(scale)), whole), 1)


def _mean_seconds(seconds: str = "seconds", timed: str = "timed") -> Column:
    return F.round(F.try_divide(F.col(seconds), F.col(timed))).cast("long")


def summary(usage: DataFrame, as_of: datetime) -> DataFrame:
    """One row of totals, counts of the present day, week and month, and rates.

    Users are grouped first.  A user is active since a moment if the latest
    start is at or after it, so one shuffle gives every distinct count.
    """
    since = {k: F.date_trunc(k, F.lit(as_of)) for k in ("day", "week", "month")}
    recent = [F.count_if(F.col("started_at") >= v).alias(f"n_{k}") for k, v in since.items()]
    users = usage.groupBy("user_id").agg(*_sums(), *recent, F.max("started_at").alias("latest"))
    known = F.col("user_id").isNotNull()
    total = users.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("started", "completed", *TOTALS)],
        *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"documents_{k}") for k in since],
        *[F.count_if(known & (F.col("latest") >= v)).alias(f"users_{k}") for k, v in since.items()],
        F.count_if(known).alias("active_users"), F.sum("seconds").alias("seconds"), F.sum("timed").alias("timed"), F.max("last_activity").alias("last_activity"),
    )
    return total.select(
        "*", share(F.col("decisions_avoided"), F.col("decisions_made") + F.col("decisions_avoided")).alias("avoided_percent"),
        share(F.col("completed"), F.col("started")).alias("completion_rate"), share(F.col("started"), F.col("active_users"), 1).alias("documents_per_user"),
        share(F.col("decisions_made"), F.col("completed"), 1).alias("decisions_per_document"), _mean_seconds().alias("mean_seconds"),
    ).drop("seconds", "timed")


def by_user(profiles: DataFrame, usage: DataFrame) -> DataFrame:
    """Every profile with its totals; usage is summed before it is joined."""
    days = F.count_distinct(F.date_trunc("day", "started_at")).alias("active_days")
    sums = usage.groupBy("user_id").agg(*_sums(), days, F.min("started_at").alias("first_activity"))
    rows = profiles.join(sums, "user_id", "left")
    counts = ("started", "completed", "incomplete", *TOTALS, "active_days")
    return rows.select("user_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], _mean_seconds().alias("mean_seconds"), "first_activity", "last_activity")


def by_organization(organizations: DataFrame, members: DataFrame, usage: DataFrame, once: bool = True) -> DataFrame:
    """Every organization with its members and totals.

    ``once=False`` counts each document once for every member, as a report does
    that joins members with documents; here the sums are multiplied instead, so
    the product of the two tables is never built.
    """
    crew = members.groupBy("organization_id").agg(F.count_distinct("user_id").alias("members"), F.count("*").alias("rows"))
    sums = usage.groupBy("organization_id").agg(*_sums(), F.count_distinct("user_id").alias("active_users"))
    rows = organizations.join(crew, "organization_id", "left").join(sums, "organization_id", "left")
    times = F.lit(1) if once else F.greatest(F.coalesce("rows", F.lit(1)), F.lit(1))
    return rows.select(
        "organization_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "active_users")],
        *[(F.coalesce(c, F.lit(0)) * times).alias(c) for c in ("started", "completed", *TOTALS)], _mean_seconds().alias("mean_seconds"), "last_activity",
    )


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """One row ``json``: all rows as an array ordered by ``key``, ``[]`` if there are none.  For reports that are already short."""
    each = F.array_sort(F.collect_list(F.struct(F.col(key).alias("_key"), F.struct(*rows.columns).alias("row"))))
    return rows.agg(F.to_json(F.transform(each, lambda x: x["row"])).alias("json"))


def broken(usage: DataFrame, as_of: datetime) -> DataFrame:
    """``(id, rule)``: the rules of the usage table that rows break; a null breaks none."""
    counts = [F.when(F.col(c) < 0, F.lit(f"{c} is negative")) for c in TOTALS]
    times = [
        F.when(F.col("completed_at") < F.col("started_at"), "completed before started"), F.when(F.col("updated_at") < F.col("started_at"), "updated before started"),
        F.when((F.col("status") == "completed") != F.col("completed_at").isNotNull(), "status and completion differ"),
        F.when(F.col("started_at") > F.lit(as_of), "started in the future"), F.when(~F.col("status").isin("started", "incomplete", "completed"), "unknown status"),
    ]
    return usage.select("id", F.explode(F.array_compact(F.array(*counts, *times))).alias("rule"))


def visible(usage: DataFrame, members: DataFrame, user: int, admin: bool = False) -> DataFrame:
    """The usage rows that a user may see: all for internal admins, else the user's own and those of organizations that the user manages."""
    if admin:
        return usage
    managed = members.filter((F.col("user_id") == user) & F.col("role").isin(*MANAGERS)).select("organization_id").distinct()
    own = usage.filter(F.col("user_id") == user)
    return own.unionByName(usage.filter(~F.col("user_id").eqNullSafe(user)).join(managed, "organization_id", "left_semi").select(*usage.columns))


def normal_email(email: Column) -> Column:
    return F.lower(F.regexp_replace(email, r"^\s+|\s+$", ""))


def pending_errors(rows: DataFrame) -> DataFrame:
    """``(organization_id, position, email, problem)`` of rows of people to invite; rows without name and address are skipped, the first of equal addresses is right."""
    used = rows.select("organization_id", "position", normal_email(F.coalesce("email", F.lit(""))).alias("email"), F.trim(F.coalesce("name", F.lit(""))).alias("name")).filter("email <> '' or name <> ''")
    nth = F.row_number().over(Window.partitionBy("organization_id", "email").orderBy("position"))
    problem = F.when(F.col("email") == "", "no address").when(~F.col("email").rlike(EMAIL_SHAPE), "bad address").when(F.col("nth") > 1, "repeated address")
    return used.withColumn("nth", nth).withColumn("problem", problem).filter("problem is not null").select("organization_id", "position", "email", "problem")


def invitation_states(invitations: DataFrame, members: DataFrame, profiles: DataFrame, as_of: datetime) -> DataFrame:
    """Invitations with ``state``: pending ones of people who are members already, or past their time, no longer wait; of equal ones the first waits."""
    wait = F.col("status") == "pending"
    inside = members.join(profiles.select("user_id", normal_email(F.col("email")).alias("mail")), "user_id").select("organization_id", "mail", F.lit(True).alias("inside")).distinct()
    rows = invitations.withColumn("mail", normal_email(F.col("email"))).join(inside, ["organization_id", "mail"], "left")
    nth = F.row_number().over(Window.partitionBy("organization_id", "mail", wait).orderBy("invitation_id"))
    state = F.when(~wait, F.col("status")).when(F.col("inside"), "accepted").when(F.col("expires_at") <= F.lit(as_of), "expired").when(nth > 1, "duplicate").otherwise("pending")
    return rows.withColumn("state", state).select("invitation_id", "organization_id", "mail", "state")


def without_owner(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes ``(change_id, organization_id, user_id, next_role)`` after which an organization has no owner; a null role removes the member.

    Each change is judged by itself.  Owners are counted once per organization.
    """
    owners = members.filter("role = 'owner'").groupBy("organization_id").agg(F.count_distinct("user_id").alias("n"))
    held = members.groupBy("organization_id", "user_id").agg(F.max((F.col("role") == "owner").cast("int")).alias("was"))
    rows = changes.join(owners, "organization_id", "left").join(held, ["organization_id", "user_id"], "left")
    stays = F.when(F.col("was").isNotNull() & (F.col("next_role") == "owner"), 1).otherwise(0)
    left = F.coalesce("n", F.lit(0)) - F.coalesce("was", F.lit(0)) + stays
    return rows.filter(left == 0).select("change_id", "organization_id", "user_id", "next_role")


def first_membership(members: DataFrame) -> DataFrame:
    """The earliest membership of every user; of equal times the least organization."""
    return members.groupBy("user_id").agg(F.min_by(F.struct("organization_id", "role"), F.struct("created_at", "organization_id")).alias("m")).select("user_id", "m.organization_id", "m.role")


def lacking(profiles: DataFrame, members: DataFrame, organizations: DataFrame) -> DataFrame:
    """Profiles that have no membership, or none in an organization that exists."""
    real = members.join(organizations.select("organization_id"), "organization_id", "left_semi")
    return profiles.join(real, "user_id", "left_anti")
