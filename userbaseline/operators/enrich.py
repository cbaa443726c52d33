"""Joins that turn stored sessions and commands into readable ones.

No join here carries a broadcast hint: Spark broadcasts a side only when its size, estimated
or measured at run time, is below the configured threshold, and otherwise shuffles both and
splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from userbaseline.functions import scalars
from userbaseline.operators import skew

# Dictionary columns of a session and of a command, by name of the readable column.
SESSION_ROLES = {
    "hostname": "hostname_ref",
    "host_ip": "host_ip_ref",
    "user": "user_ref",
    "ip": "ip_ref",
    "ports": "ports_ref",
    "created_by": "created_by_ref",
}
PLACE_ROLES = {"latitude": "latitude_ref", "longitude": "longitude_ref"}
SESSION_BLANKS = ("hostname", "host_ip", "ip", "ports", "created_by")
COMMAND_ROLES = {
    "cmd": "cmd_ref",
    "cmd_root": "cmd_root_ref",
    "parameters": "parameters_ref",
    "cwd": "cwd_ref",
    "exec_path": "exec_path_ref",
    "binary_hash": "binary_hash_ref",
}


def session_columns(sessions: DataFrame) -> DataFrame:
    """The plain columns of a session, with triggered commands net of violations."""
    return sessions.select(
        F.col("session_id").alias("id"),
        "server_id",
        F.col("stamp").alias("date_created"),
        F.col("last_ts").alias("date_last_command"),
        "commands_count",
        "violations",
        (F.col("triggered_total") - F.col("violations")).alias("triggered_count"),
        F.col("user_id").alias("auth_user_id"),
        F.col("start_ts").alias("time_created"),
    )


def _met(facts: DataFrame, side: DataFrame, key: str, how: str, heavy_rows: int | None) -> DataFrame:
    return facts.join(side, key, how) if heavy_rows is None else skew.dealt_join(facts, side, key, how, heavy_rows)


def with_server(sessions: DataFrame, servers: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Sessions on known servers, with the server's columns. With ``heavy_rows``, here and below, keys with
    more rows are dealt over copies of the other side (see `skew`)."""
    return _met(sessions, servers, "server_id", "inner", heavy_rows)


def with_project(rows: DataFrame, projects: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    return _met(rows, projects, "project_id", "inner", heavy_rows)


#: periods of up to so many days are met by day, longer ones by stretches of so many days
ERA_DAYS = 64


def disjoint_periods(periods: DataFrame) -> DataFrame:
    """(project_id, start_date, end_date): the periods of each project with those that overlap or touch made one.
    Periods without an end, or that end before they start, are left out."""
    inner = W.partitionBy("project_id").orderBy("start_date", "end_date")
    reach = F.max("end_date").over(inner.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start_date") <= reach, 0).otherwise(1)
    held = periods.filter(F.col("start_date") <= F.col("end_date"))
    numbered = held.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(inner))
    return (
        numbered.groupBy("project_id", "stretch")
        .agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
        .drop("stretch")
    )


def _by_days(periods: DataFrame, end: str = "end_date") -> tuple[DataFrame, DataFrame]:
    """The short periods with a row for each ``met`` day, and the long ones with a row for each stretch of
    days, so that a session is compared with those of its own days only."""
    first, last = (F.unix_date(F.col(c).cast("date")) for c in ("start_date", end))
    closed = periods.filter(F.col("start_date") <= F.col(end))
    short = closed.filter(last - first < ERA_DAYS).withColumn("met", F.explode(F.sequence(first, last)))
    eras = F.sequence(F.floor(first / ERA_DAYS), F.floor(last / ERA_DAYS))
    return short, closed.filter(last - first >= ERA_DAYS).withColumn("met", F.explode(eras))


def in_opt_in(
    sessions: DataFrame, periods: DataFrame, as_of: str | None = None, dedupe: bool = True
) -> DataFrame:
    """Sessions that began inside an opt-in period of their project, both ends included.

    An open period ends at ``as_of`` (now, when None). With ``dedupe=False`` a session inside
    several periods appears once per period, with the period's columns. Periods are met by project and
    day; without repetition they are made disjoint first, so that a session meets one at most.
    """
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    until = F.coalesce("end_date", now.cast("timestamp_ntz"))
    if dedupe:
        periods = disjoint_periods(periods.select("project_id", "start_date", until.alias("end_date")))
    short, long_ = _by_days(periods.withColumn("until", until), "until")
    s = sessions.alias("s")
    start = scalars.session_start_minute(F.col("s.stamp"), F.col("s.start_ts"))
    day = F.unix_date(start.cast("date"))

    def met(name: str, bucket: Column) -> Column:
        within = start.between(F.col(f"{name}.start_date"), F.col(f"{name}.until"))
        return (F.col("s.project_id") == F.col(f"{name}.project_id")) & (bucket == F.col(f"{name}.met")) & within

    by_day, by_era = met("short", day), met("long", F.floor(day / ERA_DAYS))
    short, long_ = short.alias("short"), long_.alias("long")
    if dedupe:
        both = s.join(short, by_day, "left").join(long_, by_era, "left")
        return both.filter(F.col("short.met").isNotNull() | F.col("long.met").isNotNull()).select("s.*")
    near = s.join(short, by_day).select("s.*", "short.start_date", "short.end_date")
    return near.unionAll(s.join(long_, by_era).select("s.*", "long.start_date", "long.end_date"))


def with_geo(sessions: DataFrame, ips: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Add address facts; only the shared rows (project 0) of the address table count."""
    shared = ips.filter(F.col("ip_project_id") == 0).drop("ip_project_id")
    return _met(sessions, shared, "ip_id", "left", heavy_rows)


def with_users(sessions: DataFrame, users: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    return _met(sessions, users, "user_id", "left", heavy_rows)


def decode_dictionary(dictionary: DataFrame, projects: DataFrame, keys: DataFrame) -> DataFrame:
    """Decrypt each dictionary entry once, with the key of the company that owns the project."""
    usable = keys.select("company_id", scalars.aes_key(F.col("company_key")).alias("aes_key"))
    owners = projects.join(usable, "company_id").select("project_id", "aes_key")
    return dictionary.join(owners, "project_id").select(
        "project_id",
        "id",
        scalars.decrypt_text(F.col("secret"), F.col("aes_key")).alias("value"),
    )


def _readable(name: str, blanks: Sequence[str]) -> Column:
    return scalars.blank_if_null(F.col(name)).alias(name) if name in blanks else F.col(name)


def with_roles(
    facts: DataFrame,
    dictionary: DataFrame,
    roles: Mapping[str, str],
    blanks: Sequence[str] = (),
) -> DataFrame:
    """Replace dictionary ids by values with one left join per role.

    The form for a decoded dictionary small enough to be broadcast: the facts never move.
    """
    out = facts
    for name, ref in roles.items():
        side = dictionary.select(
            F.col("project_id"), F.col("id").alias(ref), F.col("value").alias(name)
        )
        out = out.join(side, ["project_id", ref], "left")
    kept = [c for c in facts.columns if c not in roles.values()]
    return out.select(*kept, *[_readable(name, blanks) for name in roles])


def with_roles_unpivoted(
    facts: DataFrame,
    key: str,
    dictionary: DataFrame,
    roles: Mapping[str, str],
    blanks: Sequence[str] = (),
) -> DataFrame:
    """Same result as :func:`with_roles` with a single dictionary join.

    The form for a dictionary that must be shuffled: (key, role, id) rows meet it once, and the
    values are turned back into columns. Returns ``key``, ``project_id`` and the role columns;
    ``key`` must be unique in ``facts``.
    """
    entries = [
        F.struct(F.lit(name).alias("role"), F.col(ref).alias("id")) for name, ref in roles.items()
    ]
    narrow = facts.select(key, "project_id", F.inline(F.array(*entries)))
    found = narrow.join(dictionary, ["project_id", "id"], "left")
    # at most one entry per role and row, put together by hashing instead of sorting
    entry = F.when(F.col("value").isNotNull(), F.struct("role", "value"))
    read = found.groupBy(key, "project_id").agg(F.map_from_entries(F.collect_list(entry)).alias("read"))
    wide = read.select(key, "project_id", *[F.try_element_at("read", F.lit(name)).alias(name) for name in roles])
    return wide.select(key, "project_id", *[_readable(name, blanks) for name in roles])


def with_coordinates(geo_sessions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Second lookup along a chain: dictionary ids that came from the address join."""
    return with_roles(geo_sessions, dictionary, PLACE_ROLES)
