"""The registered queries: name → function of (spark, data folder).

Every query reads whole tables of the folder. Dates and times are shown as text and numbers as
64-bit values, so that results compare across engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from userbaseline.functions import scalars
from userbaseline.models import evaluation, forests
from userbaseline.models import text_features as tf
from userbaseline.operators import (
    baselines,
    command_text,
    enrich,
    features,
    rules,
    similarity,
    tenancy,
)
from userbaseline.plans import behaviour, daily, readable
from userbaseline.session import cut, scratch_path
from userbaseline.sources import event_log, readers, tenants, writers
from userbaseline.streaming import sessions as streaming

TEST_FROM = "2024-01-16"
ANOMALY_FLAGS = 2
# sessions made of such events alone have no command in the *_silent_sessions queries
SILENT = ("view", "click", "signup")
DAY = ["user_id", "day"]
# piece length with which the long-text paths are run over all days
SMALL_CHUNK = 90

Query = Callable[[SparkSession, str], DataFrame]


class Inputs:
    """The tables of one data folder and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return readers.table(self.spark, self.folder, name)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def sessions(self) -> DataFrame:
        return event_log.sessions(self.events)

    @cached_property
    def commands(self) -> DataFrame:
        return event_log.commands(self.events)

    @cached_property
    def labelled(self) -> DataFrame:
        return self.commands.withColumn("cmd_rep", event_log.rule_label(F.col("cmd_root")))

    @cached_property
    def stored(self) -> DataFrame:
        """The labelled commands as a table: several features read them, the log is joined once."""
        return cut(self.labelled)

    @cached_property
    def companies(self) -> DataFrame:
        return tenants.companies(self.table("region"))

    @cached_property
    def projects(self) -> DataFrame:
        return tenants.projects(self.table("nation"))

    @cached_property
    def servers(self) -> DataFrame:
        return tenants.servers(self.table("supplier"), self.table("nation"), self.table("region"))

    @cached_property
    def placed_sessions(self) -> DataFrame:
        return enrich.with_server(self.sessions, self.servers)

    @cached_property
    def project_commands(self) -> DataFrame:
        return tenants.with_project(self.commands, self.servers)

    @cached_property
    def dictionary_values(self) -> DataFrame:
        return tenants.dictionary_values(
            self.project_commands, self.table("nation"), self.table("region")
        )

    @cached_property
    def stored_dictionary(self) -> DataFrame:
        return tenants.encrypted_dictionary(self.dictionary_values, self.projects)

    @cached_property
    def dictionary(self) -> DataFrame:
        return enrich.decode_dictionary(
            self.stored_dictionary, self.projects, tenants.company_keys(self.table("region"))
        )

    @cached_property
    def sessions_per_day(self) -> DataFrame:
        return features.sessions_per_day(self.sessions)

    @cached_property
    def documents(self) -> DataFrame:
        return readers.spread(self.table("documents").select("doc_id", "source", "text"))

    @cached_property
    def corpus(self) -> DataFrame:
        """Documents as texts of the reputation model: labelled ones train, the rest test."""
        label = F.when(F.col("quality") == 1, "GOOD").when(F.col("quality") == 0, "BAD")
        joined = self.documents.join(self.table("labels"), "doc_id", "left")
        return joined.select(
            "doc_id",
            F.col("source").alias("session_id"),
            "text",
            label.alias("label"),
            F.when(label.isNull(), "test").otherwise("train").alias("origin"),
        )

    @cached_property
    def flags(self) -> DataFrame:
        return behaviour.flag_matrix(self.sessions, self.stored)

    @cached_property
    def day_labels(self) -> DataFrame:
        """Flag rows labelled by how many flags are up."""
        up = sum((F.col(f) for f in rules.FLAGS), F.lit(0))
        label = F.when(up >= ANOMALY_FLAGS, "ANOMALY").otherwise("NORMAL")
        return self.flags.withColumn("label", label)


def present(df: DataFrame) -> DataFrame:
    """Comparable column types."""

    def shown(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(column, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return column.cast("long").alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.round(column.cast("double"), 6).alias(field.name)
        return column

    return df.select(*[shown(f) for f in df.schema.fields])


_QUERIES: dict[str, Query] = {}


def _query(body: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return present(body(Inputs(spark, folder)))

    run.__name__ = body.__name__
    run.__doc__ = body.__doc__
    _QUERIES[body.__name__] = run
    return body


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- tables derived from the event log -----------------------------------------------------------


@_query
def sessions_from_events(t: Inputs) -> DataFrame:
    return t.sessions.select(
        "session_id", "user_id", "start_ts", "last_ts", "day", "stamp", "server_id",
        "commands_count", "violations", "triggered_total",
    )


@_query
def commands_from_events(t: Inputs) -> DataFrame:
    return t.commands.select("cmd_id", "session_id", "user_id", "ts", "day", "cmd")


# --- sources -----------------------------------------------------------------------------------


@_query
def tenant_scope_lookup(t: Inputs) -> DataFrame:
    projects = tenancy.company_projects(t.companies, t.projects, ["ASIA", "EUROPE"])
    return tenancy.servers_of(t.servers, projects).select("server_id", "project_id")


@_query
def tenant_partition_filter(t: Inputs) -> DataFrame:
    """Of a table in folders by project, only the folders of one company's projects are read."""
    path = scratch_path(t.spark, "sessions-by-project")
    t.placed_sessions.select("session_id", "user_id", "project_id").write.partitionBy("project_id").parquet(path)
    schema = "session_id long, user_id long, project_id long"
    stored = t.spark.read.schema(schema).parquet(path)
    projects = tenancy.company_projects(t.companies, t.projects, ["AFRICA"])
    rows = tenancy.rows_of_projects(stored, projects)
    return rows.select("session_id", "project_id", "user_id")


@_query
def server_count(t: Inputs) -> DataFrame:
    return readers.row_count(t.servers, "servers")


@_query
def csv_scan_roundtrip(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "commands-csv")
    t.labelled.select("cmd", F.col("cmd_rep").alias("label")).write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    return readers.labelled_commands(t.spark, path)


@_query
def csv_positional_read(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "sessions-csv")
    t.sessions.select(
        F.col("session_id").alias("a"),
        F.col("commands_count").alias("b"),
        F.when(F.col("violations") > 0, F.col("violations").cast("string"))
        .otherwise("none")
        .alias("c"),
        F.col("stamp").alias("d"),
    ).write.option("header", True).csv(path)
    return readers.positional_csv(
        t.spark, path, ["session_id", "commands", "violations", "stamp"], ["commands", "violations"]
    )


# --- projections and filters -------------------------------------------------------------------


@_query
def session_projection(t: Inputs) -> DataFrame:
    return enrich.session_columns(t.sessions)


@_query
def one_user_sessions(t: Inputs) -> DataFrame:
    """Sessions of the user with most sessions."""
    counts = t.sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # the larger count wins, the smaller id among equals
    busiest = counts.agg(F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("u"))
    rows = t.sessions.filter(F.col("user_id") == busiest.scalar())
    return rows.select("session_id", "user_id", scalars.day_text(F.col("stamp")).alias("day_stamp"), "start_ts")


@_query
def commands_semi_join(t: Inputs) -> DataFrame:
    """Commands of sessions in which something went wrong."""
    troubled = t.sessions.filter(F.col("violations") > 0)
    return tenancy.commands_of_sessions(t.commands, troubled).select("cmd_id", "session_id", "cmd")


@_query
def train_test_split_by_date(t: Inputs) -> DataFrame:
    return baselines.split_by_date(t.sessions_per_day, TEST_FROM, require_observed=True).select(
        *DAY, "idx", "first_test", "split"
    )


@_query
def latest_days(t: Inputs) -> DataFrame:
    return features.latest_days(t.sessions_per_day)


@_query
def union_with_origin(t: Inputs) -> DataFrame:
    both = features.with_origin(
        t.corpus.filter(F.col("label").isNotNull()).select("doc_id", "label"),
        t.corpus.filter(F.col("label").isNull()).select("doc_id", "label"),
    )
    return both.select("doc_id", "label", "origin")


# --- joins -------------------------------------------------------------------------------------


@_query
def session_server_join(t: Inputs) -> DataFrame:
    return t.placed_sessions.select("session_id", "server_id", "project_id", "hostname_ref")


@_query
def session_server_join_dealt(t: Inputs) -> DataFrame:
    """The same join with sessions of heavy servers dealt over copies of the server."""
    placed = enrich.with_server(t.sessions, t.servers, heavy_rows=50)
    return placed.select("session_id", "server_id", "project_id", "hostname_ref")


@_query
def geo_left_join_dealt(t: Inputs) -> DataFrame:
    found = enrich.with_geo(t.sessions, tenants.ips(t.table("nation")), heavy_rows=50)
    return found.select("session_id", "ip_id", "country_name", "ip_type", "latitude_ref")


@_query
def session_project_join(t: Inputs) -> DataFrame:
    placed = enrich.with_project(t.placed_sessions, t.projects)
    return placed.select("session_id", "server_id", "project_id", "company_id")


@_query
def optin_interval_join(t: Inputs) -> DataFrame:
    periods = tenants.opt_in(t.table("nation"), overlapping=True)
    kept = enrich.in_opt_in(t.placed_sessions, periods, tenants.AS_OF, dedupe=False)
    return kept.select("session_id", "project_id", "start_ts", "start_date", "end_date")


@_query
def optin_interval_semi(t: Inputs) -> DataFrame:
    periods = tenants.opt_in(t.table("nation"), overlapping=True)
    kept = enrich.in_opt_in(t.placed_sessions, periods, tenants.AS_OF)
    return kept.select("session_id", "project_id", "start_ts")


@_query
def geo_left_join(t: Inputs) -> DataFrame:
    found = enrich.with_geo(t.sessions, tenants.ips(t.table("nation")))
    return found.select("session_id", "ip_id", "country_name", "ip_type", "latitude_ref")


@_query
def geo_dictionary_chain(t: Inputs) -> DataFrame:
    found = enrich.with_geo(t.placed_sessions, tenants.ips(t.table("nation")))
    located = enrich.with_coordinates(found, t.dictionary)
    return located.select("session_id", "country_name", "latitude", "longitude")


@_query
def dictionary_decode(t: Inputs) -> DataFrame:
    decoded = enrich.with_roles(
        t.placed_sessions, t.dictionary, enrich.SESSION_ROLES, enrich.SESSION_BLANKS
    )
    return decoded.select("session_id", "project_id", *enrich.SESSION_ROLES)


@_query
def dictionary_decode_unpivot(t: Inputs) -> DataFrame:
    return enrich.with_roles_unpivoted(
        t.placed_sessions, "session_id", t.dictionary, enrich.SESSION_ROLES, enrich.SESSION_BLANKS
    )


@_query
def command_dictionary_decode(t: Inputs) -> DataFrame:
    stored = tenants.command_refs(t.project_commands)
    decoded = enrich.with_roles(stored, t.dictionary, enrich.COMMAND_ROLES)
    return decoded.select("cmd_id", "session_id", "project_id", *enrich.COMMAND_ROLES)


@_query
def session_rows(t: Inputs) -> DataFrame:
    """Sessions inside opt-in periods with all their look-ups."""
    nation = t.table("nation")
    return readable.session_rows(
        tenants.session_details(t.sessions), t.servers, t.projects, tenants.opt_in(nation, overlapping=True),
        tenants.ips(nation), t.dictionary, tenants.users(t.table("customer")), tenants.AS_OF,
    )


@_query
def command_rows(t: Inputs) -> DataFrame:
    """Commands of sessions inside opt-in periods with all their look-ups."""
    periods = tenants.opt_in(t.table("nation"), overlapping=True)
    allowed = enrich.in_opt_in(t.placed_sessions, periods, tenants.AS_OF)
    return readable.command_rows(tenants.command_refs(t.project_commands), allowed, t.dictionary)


@_query
def session_user_left_join(t: Inputs) -> DataFrame:
    named = enrich.with_users(t.sessions, tenants.users(t.table("customer")))
    return named.select("session_id", "user_id", "username", "full_name")


@_query
def tenant_key_decrypt(t: Inputs) -> DataFrame:
    return t.dictionary


# --- features ----------------------------------------------------------------------------------


@_query
def distinct_user_count(t: Inputs) -> DataFrame:
    return features.user_count(t.sessions)


@_query
def users_by_week_sketch(t: Inputs) -> DataFrame:
    """Users of each week from daily sketches, within 2 percent of the exact count."""
    week = F.trunc("day", "week").alias("week")
    merged = features.users_of_sketches(features.user_sketches(t.sessions).withColumn("week", week), "week")
    exact = t.sessions.groupBy(week).agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("estimate") - F.col("users")) <= 0.02 * F.col("users")
    return exact.join(merged, "week").select("week", "users", near.alias("near"))


@_query
def sorted_sessions_per_day(t: Inputs) -> DataFrame:
    """A sorted sink: every row with its place among the rows of all files, as they lie there."""
    path = scratch_path(t.spark, "sorted")
    writers.write_sorted(t.sessions_per_day, path, ["day", "user_id"], rows_per_file=500)
    return writers.in_written_order(t.spark, path).select("day", "user_id", "sessions_per_day", "place")


@_query
def distinct_users(t: Inputs) -> DataFrame:
    return features.distinct_users(t.sessions)


@_query
def distinct_sessions(t: Inputs) -> DataFrame:
    return features.distinct_sessions(t.sessions)


@_query
def observed_days(t: Inputs) -> DataFrame:
    return features.observed_days(t.sessions)


@_query
def observed_day_count(t: Inputs) -> DataFrame:
    return features.observed_day_count(t.sessions)


@_query
def sessions_per_day(t: Inputs) -> DataFrame:
    return t.sessions_per_day


@_query
def commands_per_session(t: Inputs) -> DataFrame:
    return features.commands_per_session(t.commands)


@_query
def commands_per_session_day(t: Inputs) -> DataFrame:
    return features.commands_per_session_day(t.sessions, t.commands)


@_query
def mean_commands_per_day(t: Inputs) -> DataFrame:
    return features.mean_commands_per_day(t.sessions, t.commands)


@_query
def session_duration(t: Inputs) -> DataFrame:
    return features.session_duration(t.sessions)


@_query
def session_duration_by_day(t: Inputs) -> DataFrame:
    return features.session_duration_by_day(t.sessions)


@_query
def mean_duration_per_day(t: Inputs) -> DataFrame:
    return features.mean_duration_per_day(t.sessions)


@_query
def reputation_per_session(t: Inputs) -> DataFrame:
    return features.reputation_per_session(t.labelled)


@_query
def reputation_means_per_day(t: Inputs) -> DataFrame:
    return features.reputation_means_per_day(t.sessions, t.labelled)


@_query
def reputation_share_per_day(t: Inputs) -> DataFrame:
    return features.reputation_share_per_day(t.sessions, t.labelled)


@_query
def daily_features(t: Inputs) -> DataFrame:
    return features.daily_features(t.sessions, t.labelled)


@_query
def session_command_list(t: Inputs) -> DataFrame:
    return command_text.command_text(t.commands, ["session_id"])


@_query
def day_command_text(t: Inputs) -> DataFrame:
    return command_text.command_text(t.commands, DAY)


@_query
def day_command_chunks(t: Inputs) -> DataFrame:
    """Day texts in pieces of 90 characters: the long-text path on every longer day."""
    return command_text.command_text(t.commands, DAY, chunk_chars=SMALL_CHUNK)


@_query
def day_similarity(t: Inputs) -> DataFrame:
    return similarity.day_similarity(t.commands)


@_query
def day_similarity_blocks(t: Inputs) -> DataFrame:
    """The block-wise comparison, for every pair with a text over 90 characters."""
    return similarity.day_similarity(t.commands, inline_chars=SMALL_CHUNK, block_chars=SMALL_CHUNK)


@_query
def day_similarity_first_session(t: Inputs) -> DataFrame:
    return similarity.day_similarity_first_session(t.sessions, t.commands)


# --- baselines ---------------------------------------------------------------------------------

SERIES = ["sessions_per_day"]


@_query
def day_index(t: Inputs) -> DataFrame:
    return baselines.day_index(t.sessions_per_day)


@_query
def baseline_anchors(t: Inputs) -> DataFrame:
    return baselines.anchors(t.sessions_per_day).withColumn("gap_days", F.date_diff("day", "prev_day"))


def _one(series: DataFrame, *parts: str) -> DataFrame:
    return series.select(*DAY, *[F.col(f"sessions_per_day_{p}").alias(f"{p}_value") for p in parts])


@_query
def baseline_prev_day(t: Inputs) -> DataFrame:
    return _one(baselines.with_baselines(t.sessions_per_day, SERIES), "prev")


@_query
def baseline_week(t: Inputs) -> DataFrame:
    return _one(baselines.with_baselines(t.sessions_per_day, SERIES), "week")


@_query
def baseline_week_last(t: Inputs) -> DataFrame:
    return _one(baselines.with_baselines(t.sessions_per_day, SERIES, "last"), "week")


@_query
def baseline_month(t: Inputs) -> DataFrame:
    return _one(baselines.with_baselines(t.sessions_per_day, SERIES), "month")


@_query
def baseline_rolling(t: Inputs) -> DataFrame:
    compared = baselines.with_baselines(t.sessions_per_day, SERIES)
    return compared.select(
        *DAY, "sessions_per_day", "idx", "week_idx", "month_idx",
        F.col("sessions_per_day_prev").alias("prev_value"),
        F.col("sessions_per_day_week").alias("week_value"),
        F.col("sessions_per_day_month").alias("month_value"),
        F.col("sessions_per_day_ok").alias("baseline_ok"),
    )


@_query
def baseline_frozen(t: Inputs) -> DataFrame:
    return _one(
        baselines.frozen_baselines(t.sessions_per_day, SERIES, TEST_FROM), "prev", "week", "month"
    )


# --- rules -------------------------------------------------------------------------------------


def _on_spine(t: Inputs, series: DataFrame, feature: str) -> DataFrame:
    """The feature on all days with a session, NULL where it has no value: days count by sessions."""
    if feature == "sessions_per_day":
        return series
    return t.sessions_per_day.select(*DAY).join(series.select(*DAY, feature), DAY, "left")


def _flagged(t: Inputs, series: DataFrame, feature: str) -> DataFrame:
    compared = baselines.with_baselines(_on_spine(t, series, feature), [feature])
    return compared.select(
        *DAY, F.col(feature).alias("feature_value"), rules.flag_of(feature).alias("flag"),
        F.col(f"{feature}_ok").alias("baseline_ok"),
    )


@_query
def flag_sessions(t: Inputs) -> DataFrame:
    return _flagged(t, t.sessions_per_day, "sessions_per_day")


@_query
def flag_commands(t: Inputs) -> DataFrame:
    return _flagged(t, features.mean_commands_per_day(t.sessions, t.commands), "cmd_per_day")


@_query
def flag_duration(t: Inputs) -> DataFrame:
    return _flagged(t, features.mean_duration_per_day(t.sessions), "sess_dur")


@_query
def flag_good(t: Inputs) -> DataFrame:
    return _flagged(t, features.reputation_share_per_day(t.sessions, t.labelled), "good_cmd")


@_query
def flag_bad(t: Inputs) -> DataFrame:
    return _flagged(t, features.reputation_share_per_day(t.sessions, t.labelled), "bad_cmd")


@_query
def flag_match(t: Inputs) -> DataFrame:
    return _flagged(t, similarity.day_similarity(t.commands), "five_cmd_match")


@_query
def flag_no_prev_day(t: Inputs) -> DataFrame:
    """Flags on durations, with days whose previous value is 0 or missing marked."""
    series = _on_spine(t, features.mean_duration_per_day(t.sessions), "sess_dur")
    compared = baselines.with_baselines(series, ["sess_dur"])
    prev = F.col("sess_dur_prev")
    return compared.select(
        *DAY, prev.alias("prev_value"), (prev.isNull() | (prev == 0)).alias("week_and_month_only"),
        rules.flag_of("sess_dur").alias("flag"),
    )


@_query
def flag_matrix(t: Inputs) -> DataFrame:
    return t.flags


def _some_silent(t: Inputs) -> DataFrame:
    return t.labelled.filter(~F.col("cmd_root").isin(*SILENT))


@_query
def flag_commands_silent_sessions(t: Inputs) -> DataFrame:
    """Some sessions have no command: their days count, without a value."""
    return _flagged(t, features.mean_commands_per_day(t.sessions, _some_silent(t)), "cmd_per_day")


@_query
def flag_bad_silent_sessions(t: Inputs) -> DataFrame:
    return _flagged(t, features.reputation_share_per_day(t.sessions, _some_silent(t)), "bad_cmd")


@_query
def flag_matrix_silent_sessions(t: Inputs) -> DataFrame:
    return behaviour.flag_matrix(t.sessions, cut(_some_silent(t)))


@_query
def flag_matrix_frozen(t: Inputs) -> DataFrame:
    """As-coded variant: baselines of the first test day, the week as its last value alone."""
    return behaviour.flag_matrix(
        t.sessions, t.stored, anchor="frozen", week_mode="last", test_from=TEST_FROM
    )


@_query
def flags_incremental(t: Inputs) -> DataFrame:
    """The flag matrix from a first delivery and four days after it, one by one, the second of them late."""
    path = scratch_path(t.spark, "daily")
    for name, rows in (("sessions", t.sessions), ("commands", t.labelled)):
        rows.write.partitionBy("day").parquet(f"{path}/log/{name}")
    sessions, commands = (t.spark.read.parquet(f"{path}/log/{name}") for name in ("sessions", "commands"))
    first, last = sessions.agg(F.min("day"), F.max("day")).first()
    back = [last - dt.timedelta(days=n) for n in range(5)]
    for step, (since, until) in enumerate([(first, back[4]), *((d, d) for d in (back[3], back[1], back[2], back[0]))]):
        daily.advance(t.spark, path, step, sessions, commands, since, until, lateness=1)
    return daily.current(t.spark, path)


@_query
def flag_matrix_opted_in(t: Inputs) -> DataFrame:
    """The whole way: servers, projects, opt-in periods, commands of the allowed sessions, flags."""
    periods = tenants.opt_in(t.table("nation"), overlapping=True)
    allowed, commands = behaviour.opted_in(
        t.sessions, t.labelled, t.servers, t.projects, periods, tenants.AS_OF
    )
    return behaviour.flag_matrix(allowed, cut(commands))


# --- scalar functions --------------------------------------------------------------------------


@_query
def day_from_stamp(t: Inputs) -> DataFrame:
    stamp = F.col("stamp")
    return t.sessions.select(
        "session_id",
        scalars.day_text(stamp).alias("day_stamp"),
        scalars.day_from_stamp(stamp).alias("day"),
    )


@_query
def parse_session_start(t: Inputs) -> DataFrame:
    stamp, created = F.col("stamp"), F.col("start_ts")
    return t.sessions.select(
        "session_id",
        scalars.session_start(stamp, created).alias("start_second"),
        scalars.session_start_minute(stamp, created).alias("start_minute"),
    )


@_query
def clean_text(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", scalars.clean_text(F.col("text")).alias("text"))


@_query
def trim_commas(t: Inputs) -> DataFrame:
    wrapped = F.concat(F.lit(",,"), F.col("cmd"), F.lit(",x,"))
    return t.commands.select("cmd_id", scalars.trim_commas(wrapped).alias("trimmed"))


# --- text and models ---------------------------------------------------------------------------


@_query
def term_counts(t: Inputs) -> DataFrame:
    return tf.term_counts(t.corpus)


@_query
def term_moments(t: Inputs) -> DataFrame:
    return tf.term_moments(t.corpus)


@_query
def standardised_terms(t: Inputs) -> DataFrame:
    return tf.standardised_terms(t.corpus)


@_query
def dtm_sparse(t: Inputs) -> DataFrame:
    return tf.sparse_matrix(t.corpus)[0]


@_query
def component_residuals(t: Inputs) -> DataFrame:
    """Every component solves the equation that defines it, over all terms."""
    found = tf.component_residuals(t.corpus)
    return found.select(F.col("component").cast("long"), (F.col("residual") < 1e-6).alias("solved"))


@_query
def component_correlations(t: Inputs) -> DataFrame:
    """Scores on different components are uncorrelated over the texts that the components come from."""
    found = tf.score_correlations(tf.component_scores(t.corpus, "union"))
    return found.select("i", "j", (F.round("r", 4) + F.lit(0.0)).alias("r"))


@_query
def pca_scores(t: Inputs) -> DataFrame:
    scored = tf.score_columns(tf.component_scores(t.corpus, "union"))
    return scored.select("doc_id", "origin", "scores")


@_query
def pca_scores_train(t: Inputs) -> DataFrame:
    scored = tf.score_columns(tf.component_scores(t.corpus, "train"))
    return scored.select("doc_id", "origin", "scores")


@_query
def command_reputation(t: Inputs) -> DataFrame:
    return forests.command_reputation(t.corpus).select(
        "doc_id", "origin", "label", "prediction", "probability"
    )


def _early_commands(t: Inputs) -> DataFrame:
    early = t.labelled.filter(F.col("day") < F.lit(TEST_FROM).cast("date"))
    return early.select("cmd", F.col("cmd_rep").alias("label"))


@_query
def command_reputation_join(t: Inputs) -> DataFrame:
    """Forest labels of all commands, trained on the early ones; the two kinds are separable."""
    labelled = behaviour.label_commands(t.commands, _early_commands(t))
    return labelled.select("cmd_id", "session_id", "cmd_rep")


@_query
def command_reputation_from_csv(t: Inputs) -> DataFrame:
    """The same with the training commands read from a file; the likelier label is beyond a half."""
    path = scratch_path(t.spark, "training-csv")
    _early_commands(t).write.option("header", True).option("escape", '"').csv(path)
    labelled = behaviour.label_commands(t.commands, readers.labelled_commands(t.spark, path))
    sure = (F.array_max("probability") > 0.5) & (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9)
    return labelled.select("cmd_id", "cmd_rep", sure.alias("sure"))


@_query
def reputation_holdout(t: Inputs) -> DataFrame:
    """The reputation forest on early commands whose texts it has not been trained on."""
    early, held = _early_commands(t), evaluation.held_out(F.col("cmd"))
    unseen = early.filter(held).withColumnRenamed("label", "truth")
    judged = behaviour.label_commands(unseen, early.filter(~held))
    return evaluation.confusion_matrix(judged, "truth", "cmd_rep")


@_query
def flag_matrix_modelled(t: Inputs) -> DataFrame:
    """The flag matrix with GOOD and BAD from the reputation forest."""
    labelled = behaviour.label_commands(t.commands, _early_commands(t))
    return behaviour.flag_matrix(t.sessions, cut(labelled.drop("probability")))


def _rule_predictions(t: Inputs) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "BAD").otherwise("GOOD")
    label = F.when(F.col("quality") == 1, "GOOD").otherwise("BAD")
    return t.table("labels").select("doc_id", label.alias("label"), verdict.alias("prediction"))


@_query
def confusion_matrix(t: Inputs) -> DataFrame:
    return evaluation.confusion_matrix(_rule_predictions(t))


@_query
def accuracy(t: Inputs) -> DataFrame:
    return evaluation.accuracy(_rule_predictions(t))


@_query
def reputation_confusion(t: Inputs) -> DataFrame:
    """Resubstitution check of the reputation forest on its training texts."""
    return evaluation.confusion_matrix(
        forests.command_reputation(t.corpus).filter(F.col("origin") == "train")
    )


@_query
def day_verdict(t: Inputs) -> DataFrame:
    """Days from the split date on, judged by a forest grown on the labelled days before it."""
    rows = cut(t.day_labels)  # the forest reads its rows several times
    early = F.col("day") < F.lit(TEST_FROM).cast("date")
    return behaviour.verdicts(rows.filter(~early).drop("label"), rows.filter(early))


@_query
def day_verdict_from_csv(t: Inputs) -> DataFrame:
    """All days, judged by a forest grown on early days of the file; there the label follows bad_cmd."""
    path = scratch_path(t.spark, "days-csv")
    rows = cut(t.flags)
    label = F.when(F.col("bad_cmd") == 1, "ANOMALY").otherwise("NORMAL").alias("label")
    rows.filter(F.col("day") < F.lit(TEST_FROM).cast("date")).select(*rules.FLAGS, label).write.option("header", True).csv(path)
    labelled = readers.positional_csv(t.spark, path, [*rules.FLAGS, "label"], list(rules.FLAGS))
    return behaviour.verdicts(rows, labelled).select(*DAY, "prediction")


# --- streaming ---------------------------------------------------------------------------------


@_query
def stream_sessions_per_day(t: Inputs) -> DataFrame:
    return streaming.sessions_per_day(t.spark, t.folder)
