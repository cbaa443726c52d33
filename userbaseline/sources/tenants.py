"""Tenant tables derived from the star schema: companies, projects, servers, periods, dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from userbaseline.functions import scalars
from userbaseline.sources.event_log import dictionary_id

# Start of the data, and the moment an open opt-in period is taken to end.
FIRST_DAY = "2024-01-01"
AS_OF = "2024-02-01 00:00:00"
OPT_IN_DAYS = 20
# The company whose stored key is no hex text, so nothing of it can be decrypted.
LOST_KEY_COMPANY = 4


def companies(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_regionkey").cast("long").alias("company_id"), F.col("r_name").alias("company_name")
    )


def projects(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("long").alias("project_id"),
        F.col("n_regionkey").cast("long").alias("company_id"),
    )


def servers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Servers, each named after its project (host name) and its company (address)."""
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("server_id"),
        F.col("s_nationkey").cast("long").alias("project_id"),
        dictionary_id(F.col("n_name")).alias("hostname_ref"),
        dictionary_id(F.col("r_name")).alias("host_ip_ref"),
    )


def users(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("full_name"),
    )


def opt_in(nation: DataFrame, overlapping: bool = False) -> DataFrame:
    """Opt-in periods; with ``overlapping`` some projects have a second, later-starting one."""
    project = F.col("n_nationkey").cast("long")
    start = F.lit(FIRST_DAY).cast("timestamp_ntz") + F.make_dt_interval(days=(project % 7).cast("int"))
    open_end = F.lit(None).cast("timestamp_ntz")
    end = F.when(project % 3 == 0, open_end).otherwise(
        start + F.make_dt_interval(days=F.lit(OPT_IN_DAYS))
    )
    periods = nation.select(project.alias("project_id"), start.alias("start_date"), end.alias("end_date"))
    if not overlapping:
        return periods
    second = periods.filter(F.col("project_id") % 5 == 0).select(
        "project_id",
        (F.col("start_date") + F.make_dt_interval(days=F.lit(5))).alias("start_date"),
        open_end.alias("end_date"),
    )
    return periods.unionByName(second)


def ips(nation: DataFrame) -> DataFrame:
    """Address facts; rows of project 0 are the shared ones, rows of project 1 must not match."""
    key = F.col("n_nationkey").cast("long")

    def row(project: int, country: Column) -> DataFrame:
        latitude = F.when(key % 3 == 0, "click").when(key % 3 == 1, "view").otherwise("nowhere")
        return nation.select(
            key.alias("ip_id"),
            F.lit(project).cast("long").alias("ip_project_id"),
            country.alias("country_name"),
            F.when(key % 2 == 0, "fixed").otherwise("mobile").alias("ip_type"),
            F.substring("n_name", 1, 2).alias("country_code"),
            F.concat(F.lit("continent "), F.col("n_regionkey").cast("string")).alias("continent_code"),
            F.concat(F.lit("R"), (key % 4).cast("string")).alias("region_code"),
            F.concat(F.lit("region "), (key % 4).cast("string")).alias("region_name"),
            F.concat(F.lit("city "), (key % 7).cast("string")).alias("city"),
            F.lpad(key.cast("string"), 5, "0").alias("postal_code"),
            dictionary_id(latitude).alias("latitude_ref"),
            dictionary_id(F.lit("error")).alias("longitude_ref"),
        )

    shared = row(0, F.col("n_name"))
    return shared.unionByName(row(1, F.concat(F.lit("not "), F.col("n_name"))))


def real_key(company_id: Column) -> Column:
    """The key a company encrypts with: 32 hex digits."""
    return F.md5(F.concat(F.lit("key of company "), company_id.cast("string")))


def company_keys(region: DataFrame) -> DataFrame:
    """The keys as stored: one of them is unreadable."""
    company = F.col("r_regionkey").cast("long")
    stored = F.when(company == LOST_KEY_COMPANY, "no hex text").otherwise(real_key(company))
    return region.select(company.alias("company_id"), stored.alias("company_key"))


def with_project(facts: DataFrame, servers_: DataFrame) -> DataFrame:
    """Add the project of each session or command through its server."""
    return facts.withColumn("server_id", F.col("session_id") % 10).join(
        servers_.select("server_id", "project_id"), "server_id"
    )


def dictionary_values(project_commands: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """The distinct values each project has used: (project_id, id, value)."""
    typed = project_commands.select(
        "project_id", F.explode(F.array("cmd", "cmd_root", "parameters")).alias("value")
    )
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("project_id"),
        F.explode(F.array("n_name", "r_name")).alias("value"),
    )
    used = typed.unionByName(place).distinct()
    return used.select("project_id", dictionary_id(F.col("value")).alias("id"), "value")


def encrypted_dictionary(values: DataFrame, projects_: DataFrame) -> DataFrame:
    """The dictionary as stored: values encrypted with the key of the project's company."""
    key = F.unhex(real_key(F.col("company_id")))
    secret = F.aes_encrypt(F.col("value"), key, F.lit("ECB"), F.lit("PKCS"))
    return values.join(projects_, "project_id").select("project_id", "id", secret.alias("secret"))


def command_refs(project_commands: DataFrame) -> DataFrame:
    """Commands as stored: every text is a dictionary id, some ids are NULL or unknown."""
    root = F.col("cmd_root")
    return project_commands.select(
        "cmd_id",
        "session_id",
        "project_id",
        dictionary_id(F.col("cmd")).alias("cmd_ref"),
        dictionary_id(root).alias("cmd_root_ref"),
        dictionary_id(F.col("parameters")).alias("parameters_ref"),
        F.when(root == "click", dictionary_id(F.col("parameters"))).alias("cwd_ref"),
        F.when(root == "error", F.lit("-1")).otherwise(dictionary_id(root)).alias("exec_path_ref"),
        dictionary_id(F.col("cmd")).alias("binary_hash_ref"),
        F.when(root.isin("click", "view"), "builtin").otherwise("external").alias("command_type"),
        F.date_format("ts", "yyyyMMddHH").alias("date_created"),
        F.when(root == "error", 1).otherwise(0).alias("trigger_status"),
        (F.col("cmd_id") % 2).alias("user_typed"),
        F.col("cmd_id").alias("server_cmd_id"),
        F.when(root == "signup", "LANG=C").alias("extra_vars"),
        (F.col("cmd_id") % 32768).alias("pid"),
        F.when(F.col("cmd_id") != F.col("session_id"), F.col("session_id")).alias("parent_server_cmd_id"),
        (F.col("cmd_id") % 3).alias("child_count"),
        F.col("ts").alias("time_created"),
        F.when(F.col("cmd_id") == F.col("session_id"), 1).otherwise(0).alias("is_parent"),
    )


def session_details(sessions: DataFrame) -> DataFrame:
    """Sessions with the stored columns that nothing is computed from."""
    number = F.col("session_id")
    return sessions.withColumns(
        {
            "pid": number % 32768,
            "date_disconnected": F.col("last_ts"),
            "first_time_seen": F.col("start_ts"),
            "session_duration": scalars.seconds_between(F.col("start_ts"), F.col("last_ts")),
            "ip_risk_score": F.col("ip_id") % 5,
            "how_connected": F.when(number % 2 == 0, "ssh").otherwise("console"),
            "created_ip": F.concat(F.lit("10.0.0."), F.col("ip_id").cast("string")),
            "interactive": F.when(number % 3 == 0, 0).otherwise(1),
            "duo_approver": F.concat(F.lit("approver "), (F.col("user_id") % 10).cast("string")),
            "stopped_by_user_date": F.when(F.col("violations") > 0, F.col("last_ts")),
        }
    )
