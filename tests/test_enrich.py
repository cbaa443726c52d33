import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from userbaseline.functions import scalars
from userbaseline.operators import enrich, tenancy
from userbaseline.plans import readable
from userbaseline.sources import tenants

T = dt.datetime
KEYS = {1: "00112233445566778899aabbccddeeff", 2: "ffeeddccbbaa99887766554433221100"}


@pytest.fixture(scope="module")
def sessions(spark):
    starts = {
        1: T(2024, 1, 1, 0, 0, 0),
        2: T(2024, 1, 10, 0, 0, 59),
        3: T(2024, 1, 10, 0, 1, 0),
        4: T(2024, 3, 1, 12, 0, 0),
        5: T(2023, 12, 31, 23, 59, 59),
    }
    rows = [(i, i, 1 if i != 4 else 2, t, t.strftime("%Y%m%d%H"), i % 3) for i, t in starts.items()]
    return spark.createDataFrame(
        rows,
        "session_id long, user_id long, project_id long, start_ts timestamp_ntz, stamp string, ip_id long",
    )


@pytest.fixture(scope="module")
def periods(spark):
    return spark.createDataFrame(
        [(1, T(2024, 1, 1), T(2024, 1, 10)), (1, T(2023, 12, 31), T(2024, 1, 2)), (2, T(2024, 2, 1), None)],
        "project_id long, start_date timestamp_ntz, end_date timestamp_ntz",
    )


def ids(df):
    return sorted(r.session_id for r in df.collect())


def test_opt_in_is_closed_at_both_ends_and_tested_by_the_minute(sessions, periods):
    # session 2 starts at second 59 of the last minute
    assert ids(enrich.in_opt_in(sessions, periods, "2024-04-01 00:00:00")) == [1, 2, 4, 5]


def test_open_period_ends_at_as_of(sessions, periods):
    assert 4 not in ids(enrich.in_opt_in(sessions, periods, "2024-02-15 00:00:00"))
    assert 4 in ids(enrich.in_opt_in(sessions, periods))


def test_overlapping_periods_repeat_a_session_only_when_asked(sessions, periods):
    kept = enrich.in_opt_in(sessions, periods, "2024-04-01 00:00:00", dedupe=False)
    assert ids(kept) == [1, 1, 2, 4, 5]


def test_many_periods_of_one_project(spark):
    """10,000 periods, overlapping, touching, empty and long ones: rows compared stay near rows out."""
    rnd = random.Random(5)
    at = lambda minutes: T(2020, 1, 1) + dt.timedelta(minutes=minutes)
    spans = []
    for _ in range(10_000):
        begin = rnd.randrange(2_000_000)
        spans.append((begin, begin + rnd.choice([0, 3, 40, 500, -5])))
    spans += [(2_100_000, 2_400_000), (2_400_000, 2_400_100), (2_600_000, 10**9)]
    periods = spark.createDataFrame([(1, at(a), at(b)) for a, b in spans], "project_id long, start_date timestamp_ntz, end_date timestamp_ntz")
    starts = [rnd.randrange(3_000_000) for _ in range(1_500)]
    rows = [(i, 1 if i % 10 else 2, at(m), at(m).strftime("%Y%m%d%H")) for i, m in enumerate(starts)]
    sessions = spark.createDataFrame(rows, "session_id long, project_id long, start_ts timestamp_ntz, stamp string")
    inside = {i: [s for s in spans if s[0] <= m <= s[1]] for i, m in enumerate(starts) if i % 10}
    assert ids(enrich.in_opt_in(sessions, periods, "2030-01-01 00:00:00")) == sorted(i for i, found in inside.items() if found)
    repeated = enrich.in_opt_in(sessions, periods, "2030-01-01 00:00:00", dedupe=False)
    assert ids(repeated) == sorted(i for i, found in inside.items() for _ in found)
    # disjoint stretches in all
    merged = sorted((r.start_date, r.end_date) for r in enrich.disjoint_periods(periods).collect())
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))
    # by day a session meets few of them
    short, long_ = enrich._by_days(enrich.disjoint_periods(periods))
    assert short.groupBy("project_id", "met").count().agg(F.avg("count")).first()[0] < 12
    assert long_.groupBy("project_id", "met").count().agg(F.max("count")).first()[0] <= 2


def test_geo_uses_the_shared_rows_only(spark, sessions):
    ips = spark.createDataFrame(
        [(0, 0, "A"), (1, 1, "decoy")], "ip_id long, ip_project_id long, country_name string"
    )
    got = {r.session_id: r.country_name for r in enrich.with_geo(sessions, ips).collect()}
    assert got == {1: None, 2: None, 3: "A", 4: None, 5: None}


def test_users_left_join(spark, sessions):
    users = spark.createDataFrame([(1, "ann")], "user_id long, username string")
    got = {r.session_id: r.username for r in enrich.with_users(sessions, users).collect()}
    assert got[1] == "ann" and got[2] is None and len(got) == 5


@pytest.fixture(scope="module")
def dictionary(spark):
    plain = spark.createDataFrame(
        [(1, 10, "ls"), (1, 11, "héllo"), (2, 10, "other")], "project_id long, id long, value string"
    )
    key = F.when(F.col("project_id") == 1, F.lit(KEYS[1])).otherwise(F.lit(KEYS[2]))
    return plain.select(
        "project_id", "id", F.aes_encrypt("value", F.unhex(key), F.lit("ECB"), F.lit("PKCS")).alias("secret")
    )


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([(1, 7), (2, 8)], "project_id long, company_id long")


def keys(spark, first, second):
    return spark.createDataFrame([(7, first), (8, second)], "company_id long, company_key string")


def decoded(spark, dictionary, projects, first, second):
    out = enrich.decode_dictionary(dictionary, projects, keys(spark, first, second))
    return {(r.project_id, r.id): r.value for r in out.collect()}


def test_each_company_has_its_own_key(spark, dictionary, projects):
    assert decoded(spark, dictionary, projects, KEYS[1], KEYS[2]) == {
        (1, 10): "ls", (1, 11): "héllo", (2, 10): "other",
    }


@pytest.mark.parametrize("bad", ["xyz", "0011", None])
def test_unusable_key_gives_null(spark, dictionary, projects, bad):
    got = decoded(spark, dictionary, projects, bad, KEYS[2])
    assert got == {(1, 10): None, (1, 11): None, (2, 10): "other"}


def test_wrong_key_never_gives_the_text(spark, dictionary, projects):
    got = decoded(spark, dictionary, projects, KEYS[2], KEYS[1])
    assert got[1, 10] != "ls" and got[2, 10] != "other"


def test_damaged_bytes_give_null(spark):
    df = spark.createDataFrame([(bytearray(b"123"),)], "secret binary")
    key = scalars.aes_key(F.lit(KEYS[1]))
    assert df.select(scalars.decrypt_text(F.col("secret"), key)).first()[0] is None


def folded(key: bytes) -> bytes:
    out = bytearray(16)
    for i, byte in enumerate(key):
        out[i % 16] ^= byte
    return bytes(out)


@pytest.mark.parametrize("length", [0, 1, 2, 15, 16, 17, 24, 32, 33, 48, 64])
def test_keys_of_any_length_become_sixteen_bytes(spark, length):
    key = bytes((i * 37 + 200) % 256 for i in range(length))
    df = spark.createDataFrame([(key.hex(),)], "k string")
    assert bytes(df.select(scalars.aes_key(F.col("k"))).first()[0]) == folded(key)


def test_key_without_hex_digits(spark):
    df = spark.createDataFrame([("no hex",), (None,)], "k string")
    assert [r[0] for r in df.select(scalars.aes_key(F.col("k"))).collect()] == [None, None]


def test_roles_both_ways(spark, dictionary, projects):
    values = enrich.decode_dictionary(dictionary, projects, keys(spark, KEYS[1], KEYS[2]))
    facts = spark.createDataFrame(
        [(1, 1, 10, 11), (2, 2, 10, 11), (3, 1, None, 10)],
        "session_id long, project_id long, a_ref long, b_ref long",
    )
    roles = {"a": "a_ref", "b": "b_ref"}
    want = [(1, 1, "ls", "héllo"), (2, 2, "other", ""), (3, 1, None, "ls")]
    joined = enrich.with_roles(facts, values, roles, ["b"])
    turned = enrich.with_roles_unpivoted(facts, "session_id", values, roles, ["b"])
    for out in (joined, turned):
        assert sorted(map(tuple, out.select("session_id", "project_id", "a", "b").collect())) == want


def test_tenant_scope(spark, projects):
    companies = spark.createDataFrame([(7, "Acme"), (8, "Other")], "company_id long, company_name string")
    servers = spark.createDataFrame([(1, 1), (2, 2)], "server_id long, project_id long")
    own = tenancy.company_projects(companies, projects, ["Acme"])
    assert [r.server_id for r in tenancy.servers_of(servers, own).collect()] == [1]


def test_project_filter_prunes_folders(spark, sessions, tmp_path):
    path = str(tmp_path / "sessions")
    sessions.write.partitionBy("project_id").parquet(path)
    kept = tenancy.project_rows(spark.read.parquet(path), [2])
    assert ids(kept) == [4]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*\(project_id#\d+ = 2\)", plan)


def test_user_filter(sessions):
    assert ids(tenancy.rows_of_user(sessions, 3)) == [3]


def test_start_from_parts(spark):
    df = spark.createDataFrame(
        [("2024010109", T(2024, 1, 1, 9, 5, 7)), ("bad", T(2024, 1, 1, 9, 5, 7)), (None, None)],
        "stamp string, t timestamp_ntz",
    )
    got = df.select(scalars.session_start(F.col("stamp"), F.col("t"))).collect()
    assert [r[0] for r in got] == [T(2024, 1, 1, 9, 5, 7), None, None]


def test_text_scalars(spark):
    df = spark.createDataFrame([(",a,b,", " Ls\t\n-L 42é  X1yz ")], "a string, b string")
    r = df.select(
        scalars.trim_commas(F.col("a")).alias("trimmed"),
        scalars.clean_text(F.col("b")).alias("clean"),
        scalars.terms(F.col("b")).alias("terms"),
    ).first()
    assert (r.trimmed, r.clean, r.terms) == ("a,b", " ls -l é xyz ", ["xyz"])


def test_whole_rows_keep_unknown_references(spark):
    sessions = spark.sql(
        """SELECT * FROM VALUES (1L, 7L, 1L, 'h1', 'gone'), (2L, NULL, 9L, NULL, 'h1'), (3L, 7L, 1L, 'h1', 'h1')
        AS t(session_id, user_id, ip_id, user_ref, ip_ref)"""
    ).selectExpr(
        "*", "IF(session_id = 3, 99L, 5L) AS server_id", "'2024010210' AS stamp",
        "TIMESTAMP_NTZ'2024-01-02 10:05:09' AS start_ts", "TIMESTAMP_NTZ'2024-01-02 10:05:19' AS last_ts",
        "2L AS commands_count", "1L AS violations", "3L AS triggered_total",
        "CAST(NULL AS string) AS ports_ref", "'h1' AS created_by_ref",
    )
    servers = spark.sql("SELECT 5L AS server_id, 4L AS project_id, 'h1' AS hostname_ref, 'h2' AS host_ip_ref")
    projects = spark.sql("SELECT 4L AS project_id, 1L AS company_id")
    # two periods that overlap: a session is shown once all the same
    periods = spark.sql(
        """SELECT 4L AS project_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS start_date,
        CAST(NULL AS timestamp_ntz) AS end_date FROM range(2)"""
    )
    nation = spark.sql("SELECT 1 AS n_nationkey, 'FRANCE' AS n_name, 0 AS n_regionkey")
    users = spark.sql("SELECT 7L AS user_id, 'u7' AS username, 'User 7' AS full_name")
    dictionary = spark.sql("SELECT * FROM VALUES (4L, 'h1', 'one'), (4L, 'h2', 'two') AS t(project_id, id, value)")
    rows = readable.session_rows(
        tenants.session_details(sessions), servers, projects, periods, tenants.ips(nation), dictionary, users,
        "2024-02-01 00:00:00",
    )
    assert rows.columns == list(readable.SESSION_COLUMNS)
    first, second = rows.orderBy("id").collect()  # the third has no known server
    assert (first.user, first.ip, first.hostname, first.host_ip, first.ports) == ("one", "", "one", "two", "")
    assert (first.cmd_username, first.country_name, first.country_code) == ("u7", "FRANCE", "FR")
    assert (first.triggered_count, first.session_duration) == (2, 10)
    assert (second.user, second.ip, second.cmd_username, second.country_name) == (None, "one", None, None)
