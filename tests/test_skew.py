"""Joins with heavy keys against the plain join."""

import pytest
from pyspark.sql import functions as F

from userbaseline.operators import enrich, skew


@pytest.fixture
def facts(spark):
    """Half of 60,000 sessions on one server, a sixth on none, the others over 400; ids repeat."""
    server = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 400)
    return spark.range(60_000).select((F.col("id") % 59_000).alias("session_id"), server.cast("long").alias("server_id"))


@pytest.fixture
def servers(spark):
    """Server 7 twice, server 9 unknown, a server without a number."""
    rows = [(n, f"host {n}") for n in range(400) if n != 9] + [(7, "other"), (None, "nobody")]
    return spark.createDataFrame(rows, "server_id long, host string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_are_those_of_the_plain_join(facts, servers, how):
    got = skew.dealt_join(facts, servers, "server_id", how, heavy_rows=1_000)
    want = facts.join(servers, "server_id", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_heavy_keys_are_counted(facts, monkeypatch):
    found = {r.server_id: r[1] for r in skew.heavy_keys(facts, "server_id", 10_000).collect()}
    assert found == {7: 4}
    assert skew.heavy_keys(facts.filter("false"), "server_id").count() == 0
    monkeypatch.setattr(skew, "MOST_HEAVY", 3)
    assert [r.server_id for r in skew.heavy_keys(facts, "server_id", 10).collect()] == [7]


def test_no_task_gets_three_times_the_median(spark, facts, servers):
    """Where neither a broadcast nor the runtime's splitting helps, a heavy key spreads over the tasks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def sizes(joined):
            return sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())

        plain = sizes(enrich.with_users(facts.withColumnRenamed("server_id", "user_id"), servers.withColumnRenamed("server_id", "user_id")))
        dealt = sizes(skew.dealt_join(facts, servers, "server_id", "left", heavy_rows=300))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plain[-1] > 5 * plain[len(plain) // 2]
    assert dealt[-1] < 3 * dealt[len(dealt) // 2]


def test_only_joins_that_keep_the_facts_side(facts, servers):
    with pytest.raises(ValueError, match="full"):
        skew.dealt_join(facts, servers, "server_id", "full")


def test_empty_tables(facts, servers):
    assert skew.dealt_join(facts.filter("false"), servers, "server_id").count() == 0
    assert skew.dealt_join(facts, servers.filter("false"), "server_id", "left", heavy_rows=500).count() == 60_000
