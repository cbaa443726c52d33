"""From sessions and commands to flags and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from userbaseline.models import forests
from userbaseline.operators import enrich, features, rules, similarity, tenancy
from userbaseline.sources import readers


def opted_in(
    sessions: DataFrame,
    commands: DataFrame,
    servers: DataFrame,
    projects: DataFrame,
    periods: DataFrame,
    as_of: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The sessions that may be analysed, and the commands typed in them. Stops when there is none."""
    placed = enrich.with_project(enrich.with_server(sessions, servers), projects)
    allowed = readers.require_rows(enrich.in_opt_in(placed, periods, as_of), "sessions inside an opt-in period")
    return allowed, tenancy.commands_of_sessions(commands, allowed)


def all_features(sessions: DataFrame, labelled_commands: DataFrame) -> DataFrame:
    """All six features on the (user, day) spine of days with a session."""
    daily = features.daily_features(sessions, labelled_commands)
    return daily.join(similarity.day_similarity(labelled_commands), ["user_id", "day"], "left")


def flag_matrix(sessions: DataFrame, labelled_commands: DataFrame, **options) -> DataFrame:
    """Six flags for every user-day; options as in :func:`rules.flags`."""
    return rules.flags(all_features(sessions, labelled_commands), **options)


def label_commands(commands: DataFrame, training: DataFrame, **options) -> DataFrame:
    """Commands with ``cmd_rep`` (and ``probability``) from the reputation forest.

    ``training`` has (cmd, label); options as in :func:`text_features.text_scores`.
    """
    known = training.select(
        F.col("cmd").alias("text"), "label", F.lit("train").alias("origin")
    )
    typed = commands.withColumns({"text": F.lower("cmd"), "origin": F.lit("test")})
    corpus = known.unionByName(typed, allowMissingColumns=True)
    labelled = forests.command_reputation(corpus, **options).filter(F.col("origin") == "test")
    return labelled.withColumnRenamed("prediction", "cmd_rep").drop("origin", "label")


def verdicts(flag_rows: DataFrame, training: DataFrame) -> DataFrame:
    """A label for every user-day from the forest grown on ``training`` (six flags, label)."""
    return forests.day_verdict(forests.fit_day_verdict(training), flag_rows)
