import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from userbaseline.operators import features
from userbaseline.session import cut, shared_dir
from userbaseline.sources import event_log, readers, writers
from userbaseline.streaming import sessions as streaming

T = dt.datetime


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    # one user with a third of all events, among them many in one second
    times = [T(2024, 1, 1) + dt.timedelta(minutes=17 * i) for i in range(300)] + [T(2024, 1, 3)] * 200
    times += [T(2024, 1, 9, 5, 59, 59), T(2024, 1, 9, 11, 59, 59), T(2024, 1, 9, 17, 59, 58)]
    rows += [(1, t) for t in times]
    for user in range(2, 60):
        rows += [(user, T(2024, 1, 1) + dt.timedelta(hours=(user * 7 + k * 5 + k * k) % 240)) for k in range(17)]
    full = [(i, t, u, ["error", "view", "signup"][i % 3], 1.0, '{"k": 1}') for i, (u, t) in enumerate(rows)]
    return spark.createDataFrame(full, streaming.EVENTS)


def plain_sessions(rows, gap=dt.timedelta(hours=6)):
    out, users = {}, {}
    for r in rows:
        users.setdefault(r.user_id, []).append((r.ts, r.event_id))
    for user, points in users.items():
        current = []
        for ts, event in sorted(points):
            if current and ts - current[-1][0] >= gap:
                out[min(e for _, e in current)] = (user, current[0][0], current[-1][0], len(current))
                current = []
            current.append((ts, event))
        out[min(e for _, e in current)] = (user, current[0][0], current[-1][0], len(current))
    return out


@pytest.mark.parametrize("hours", [1, 6, 7])
def test_sessions_as_by_hand(events, hours):
    want = plain_sessions(events.collect(), dt.timedelta(hours=hours))
    got = {
        r.session_id: (r.user_id, r.start_ts, r.last_ts, r.commands_count)
        for r in event_log.sessions(events, hours).collect()
    }
    assert got == want


def test_every_event_is_a_command_of_its_session(events):
    want = plain_sessions(events.collect())
    commands = event_log.commands(events).collect()
    assert sorted(r.cmd_id for r in commands) == list(range(events.count()))
    for r in commands:
        user, start, last, _ = want[r.session_id]
        assert r.user_id == user and start <= r.ts <= last and r.day == start.date()


def test_events_are_combined_before_the_shuffle(events):
    plan = event_log.sessions(events)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "SortAggregate" not in plan


def test_stream_equals_batch_on_closed_sessions(spark, events, tmp_path):
    source = str(tmp_path / "in")
    half = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    for i, part in enumerate(half):
        part.coalesce(1).write.parquet(f"{source}/part{i}")
    stream = spark.readStream.schema(streaming.EVENTS).parquet(f"{source}/*")
    closed = streaming.run_available(
        streaming.closed_sessions(stream), str(tmp_path / "out"), str(tmp_path / "state")
    )
    edge = events.agg({"ts": "max"}).first()[0] - dt.timedelta(days=1)
    want = sorted(
        (u, a, b, n)
        for u, a, b, n in plain_sessions(events.collect()).values()
        if b + dt.timedelta(hours=6) <= edge
    )
    assert sorted(map(tuple, closed.collect())) == want and want


def test_empty_input_is_refused(spark, events):
    assert readers.require_rows(events, "events") is events
    with pytest.raises(ValueError):
        readers.require_rows(events.filter("false"), "events")
    with pytest.raises(ValueError):
        readers.require_rows(spark.createDataFrame([], "a int").select(), "events")


def test_positional_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("some,header,row\n1,x,ANOMALY\n0,1,\"a \"\"quoted\"\" one\"\n")
    got = readers.positional_csv(spark, str(path), ["a", "b", "label"], ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(1, None, "ANOMALY"), (0, 1, 'a "quoted" one')]


def test_labelled_and_key_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cmd,label\nls,GOOD\n")
    (tmp_path / "k.csv").write_text("company_id,company_key\n1,00ff\n")
    assert readers.labelled_commands(spark, str(tmp_path / "c.csv")).first().label == "GOOD"
    assert readers.company_keys(spark, str(tmp_path / "k.csv")).first().company_id == 1
    assert readers.csv_table(spark, str(tmp_path / "k.csv")).schema["company_id"].dataType.typeName() == "integer"


def test_jdbc_bounds_go_together(spark):
    with pytest.raises(ValueError):
        readers.jdbc_table(spark, "jdbc:none:", "t", partition_column="id")
    with pytest.raises(ValueError):
        readers.jdbc_table(spark, "jdbc:none:", "t", partitions=4)


class FakeSession:
    """As much of a session as the choice of the shared folder looks at."""

    def __init__(self, master, named=None):
        self.master, self.named, self.set_to = master, named, None
        self.sparkContext = self.conf = self

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.set_to

    def setCheckpointDir(self, path):
        self.set_to = path


def test_shared_folder():
    assert shared_dir(FakeSession("spark://host:7077", "hdfs://shared/c")) == "hdfs://shared/c"
    assert shared_dir(FakeSession("local[2]", "/shared/c")) == "/shared/c"
    assert "userbaseline-" in shared_dir(FakeSession("local[2]"))
    with pytest.raises(ValueError):
        shared_dir(FakeSession("spark://host:7077"))


def test_a_cut_keeps_rows_and_schema(spark, events):
    kept = cut(events)
    assert kept.schema == events.schema
    assert sorted(kept.collect()) == sorted(events.collect())
    assert kept.inputFiles()[0].startswith(("file:", "/"))


def test_sorted_files_follow_one_another(spark, tmp_path):
    rows = spark.range(5_000).select((F.col("id") * 37 % 101).alias("day"), F.when(F.col("id") % 50 > 0, F.col("id") % 50).alias("user_id"), "id")
    path = str(tmp_path / "sorted")
    writers.write_sorted(rows, path, ["day", "user_id"], rows_per_file=600)
    placed = writers.in_written_order(spark, path).orderBy("place").collect()
    keys = [(r.day, r.user_id is not None, r.user_id or 0) for r in placed]
    assert [r.place for r in placed] == list(range(5_000)) and keys == sorted(keys)
    files = sorted(p for p in os.listdir(path) if p.endswith(".parquet"))
    assert len(files) > 5
    ends = []
    for name in files:
        held = [(r.day, r.user_id is not None, r.user_id or 0) for r in spark.read.parquet(f"{path}/{name}").collect()]
        ends.append((min(held), max(held)))
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_user_sketches_merge_within_two_percent(spark):
    sessions = spark.range(200_000).select(
        (F.col("id") % 60_000).alias("user_id"), F.expr("date_add(date'2024-01-01', cast(id % 7 as int))").alias("day")
    ).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS user_id, date'2024-01-01' AS day"))
    sketches = features.user_sketches(sessions)
    assert sketches.count() == 7
    estimate = features.users_of_sketches(sketches).first().estimate
    assert abs(estimate - 60_000) < 0.02 * 60_000
