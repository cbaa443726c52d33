"""Which rows belong to a company, a project, a user, a set of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def company_projects(
    companies: DataFrame, projects: DataFrame, names: Sequence[str]
) -> DataFrame:
    """The projects of the named companies."""
    named = companies.filter(F.col("company_name").isin(*names))
    return projects.join(named, "company_id", "left_semi")


def servers_of(servers: DataFrame, projects: DataFrame) -> DataFrame:
    """The servers of a set of projects."""
    return servers.join(projects, "project_id", "left_semi")


def project_rows(facts: DataFrame, project_ids: Sequence[int]) -> DataFrame:
    """Rows of literal projects; on a table partitioned by project_id only those folders are read."""
    return facts.filter(F.col("project_id").isin(*project_ids))


def rows_of_projects(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of a set of projects given as a table. Of facts in folders by project only the folders of these
    projects are read: Spark finds them from the small table while the query runs."""
    return facts.join(projects.select("project_id").distinct(), "project_id").select(*facts.columns)


def rows_of_user(facts: DataFrame, user_id: int) -> DataFrame:
    return facts.filter(F.col("user_id") == user_id)


def commands_of_sessions(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """The commands typed in a set of sessions."""
    return commands.join(sessions.select("session_id"), "session_id", "left_semi")
