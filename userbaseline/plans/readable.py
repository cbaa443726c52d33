"""Sessions and commands as analysts read them: all look-ups of a row in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from userbaseline.operators import enrich, tenancy

# Columns of a readable session and of a readable command.
SESSION_COLUMNS = (
    "id", "server_id", "pid", "hostname", "host_ip", "user", "cmd_username", "cmd_fullname", "ip",
    "date_created", "date_disconnected", "first_time_seen", "country_code", "ip_type", "session_duration",
    "date_last_command", "commands_count", "violations", "country_name", "region_code", "city", "postal_code",
    "latitude", "longitude", "continent_code", "region_name", "ip_risk_score", "project_id", "triggered_count",
    "how_connected", "ports", "created_ip", "created_by", "interactive", "auth_user_id", "duo_approver",
    "time_created", "stopped_by_user_date",
)
COMMAND_COLUMNS = (
    "id", "command_type", "date_created", "trigger_status", "user_typed", "session_id", "server_cmd_id",
    "extra_vars", "pid", "parent_server_cmd_id", "child_count", "time_created", "is_parent",
    "cmd", "cmd_root", "parameters", "cwd", "exec_path", "binary_hash",
)


def _decoded(
    facts: DataFrame, key: str, dictionary: DataFrame, roles: Mapping[str, str], blanks: Sequence[str] = ()
) -> DataFrame:
    """Facts with all their dictionary columns read in a single join with the dictionary."""
    read = enrich.with_roles_unpivoted(facts, key, dictionary, roles, blanks)
    return facts.drop(*roles.values()).join(read, [key, "project_id"])


def session_rows(
    sessions: DataFrame,
    servers: DataFrame,
    projects: DataFrame,
    periods: DataFrame,
    ips: DataFrame,
    dictionary: DataFrame,
    users: DataFrame,
    as_of: str | None = None,
) -> DataFrame:
    """Sessions inside an opt-in period, each once, with server, address, user and decoded columns.

    ``dictionary`` is decoded already. Sessions with an unknown address, user or dictionary id stay.
    """
    placed = enrich.with_project(enrich.with_server(sessions, servers), projects)
    allowed = enrich.in_opt_in(placed, periods, as_of)
    known = enrich.with_users(enrich.with_geo(allowed, ips), users)
    roles = enrich.SESSION_ROLES | enrich.PLACE_ROLES
    decoded = _decoded(known, "session_id", dictionary, roles, enrich.SESSION_BLANKS)
    named = decoded.withColumns(
        {
            "id": F.col("session_id"),
            "cmd_username": F.col("username"),
            "cmd_fullname": F.col("full_name"),
            "date_created": F.col("stamp"),
            "date_last_command": F.col("last_ts"),
            "triggered_count": F.col("triggered_total") - F.col("violations"),
            "auth_user_id": F.col("user_id"),
            "time_created": F.col("start_ts"),
        }
    )
    return named.select(*SESSION_COLUMNS)


def command_rows(commands: DataFrame, sessions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The commands typed in ``sessions`` with decoded columns."""
    typed = tenancy.commands_of_sessions(commands, sessions)
    decoded = _decoded(typed, "cmd_id", dictionary, enrich.COMMAND_ROLES)
    return decoded.withColumnRenamed("cmd_id", "id").select(*COMMAND_COLUMNS)
