import random

import pytest
from calendar_days import day
from hypothesis import given, settings
from hypothesis import strategies as st

from userbaseline.functions.edit_distance import edge_sum, pack, rectangle, tile, unpack
from userbaseline.operators import command_text as ct
from userbaseline.operators import similarity as s


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_similarity(a, b):
    longer = max(len(a), len(b))
    return 1.0 if longer == 0 else 1.0 - plain_distance(a, b) / longer


texts = st.text(alphabet="abcé ", min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts, texts, st.integers(1, 17))
def test_rectangles_make_up_the_distance(a, b, size):
    rows = [a[i : i + size] for i in range(0, len(a), size)]
    columns = [b[i : i + size] for i in range(0, len(b), size)]
    edges = [None] * len(columns)
    total = len(b)
    for r in rows:
        left = None
        for j, c in enumerate(columns):
            left, edges[j] = rectangle(r, c, left, edges[j])
            left = unpack(pack(left, len(r)))
        total += edge_sum(left)
    assert total == plain_distance(a, b)


@settings(max_examples=400, deadline=None)
@given(texts, texts, st.integers(1, 9), st.integers(1, 4), st.integers(1, 40))
def test_tiles_in_a_band_never_fall_short_and_are_exact_inside_it(a, b, side, parts, band):
    """Tiles of several rectangles, with edges handed on as the sweep does."""
    block = side * parts
    want, band = plain_distance(a, b), max(band, abs(len(a) - len(b)))
    rights, bottoms, corner = {}, {}, None
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            if j - min(i + block, len(a)) > band or i - min(j + block, len(b)) > band:
                continue
            found = tile(a[i : i + block], b[j : j + block], rights.get((i, j - block)), bottoms.get((i - block, j)), i, j, band, side)
            rights[i, j], bottoms[i, j], corner = found
    assert corner >= want
    if corner <= band or band >= max(len(a), len(b)):
        assert corner == want


def day_texts(rows):
    days = {}
    for i, (user, n, _, second, text) in enumerate(rows):
        if text is not None:
            days.setdefault((user, n), []).append((second, i, text.lower()))
    return {k: " ".join(t for *_, t in sorted(v)) for k, v in days.items()}


def expected(rows):
    days = day_texts(rows)
    out = {}
    for user, n in sorted(days):
        earlier = [m for u, m in days if u == user and m < n]
        now = days[user, n]
        out[user, day(n)] = plain_similarity(now, days[user, max(earlier)]) if earlier else 1.0
    return out


def got(df):
    return {(r.user_id, r.day): r.five_cmd_match for r in df.collect()}


@pytest.fixture(scope="module")
def mixed():
    """Three users, one of them with most of the commands, some texts long and some empty."""
    rnd = random.Random(7)
    words = ["ls -l", "cd /tmp", "rm é", "CAT x", "git status"]
    rows = []
    for user, per_day in ((1, 90), (2, 3), (3, 1)):
        for n in (1, 2, 4, 9):
            for k in range(per_day if n != 4 else 2):
                rows.append((user, n, user * 100 + n, rnd.randrange(50), rnd.choice(words)))
    rows += [(4, 1, 41, 0, ""), (4, 2, 42, 0, ""), (4, 3, 43, 0, "x" * 200), (4, 4, 44, 0, "")]
    rows += [(5, 1, 51, 0, None), (5, 2, 52, 0, "abc"), (5, 3, 53, 0, "xyz"), (5, 4, 54, 0, "xyz")]
    return rows


def test_all_ways_give_the_same(command_rows, mixed):
    commands = command_rows(mixed)
    want = expected(mixed)
    for options in ({}, {"inline_chars": 30, "block_chars": 50, "band": 4}, {"inline_chars": 0, "block_chars": 211, "band": 1}):
        assert got(s.day_similarity(commands, **options)) == pytest.approx(want), options


def test_equal_heads_are_left_out(command_rows):
    text = "".join(random.Random(1).choice("abcd ") for _ in range(600))
    later = {2: text, 3: text + "more", 4: text[:300] + "X" + text[300:], 5: text[1:], 6: "q" * 40}
    rows = [(1, 1, 1, 0, text)] + [(1, n, n, 0, t) for n, t in later.items()]
    commands = command_rows(rows)
    assert got(s.day_similarity(commands, 20, 64, 8)) == pytest.approx(expected(rows))


def test_a_long_day_leaves_the_others_alone(command_rows, mixed):
    """Short pairs have the same plan and rows whether another user has a long day or not."""
    kinds = ("Join", "Window", "Aggregate", "Exchange", "Generate", "MapInArrow")

    def nodes(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [k for line in plan.split("\n") for k in kinds if k in line]

    short = [r for r in mixed if r[0] in (2, 3, 5)]
    alone = s.day_similarity(command_rows(short), 2_048, 4_096)
    beside = s.day_similarity(command_rows([*short, (9, 1, 90, 0, "x" * 9_000), (9, 2, 91, 0, "x" * 8_000 + "y")]), 2_048, 4_096)
    assert nodes(alone)
    met = [k for k in nodes(beside)]
    assert len(met) > len(nodes(alone))
    assert {k: v for k, v in got(beside).items() if k[0] != 9} == got(alone) == pytest.approx(expected(short))


def test_near_copies_of_a_megabyte(command_rows):
    """A few jobs, of work in proportion to length times distance."""
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1_000_000))
    changed = "zz" + text[:400_000] + "!" * 30 + text[400_050:900_000] + "?" + text[900_001:]
    commands = command_rows([(1, 1, 1, 0, text), (1, 2, 2, 0, changed), (2, 1, 3, 0, "a"), (2, 2, 4, 0, "b")])
    found = got(s.day_similarity(commands))
    # two put before, a stretch of fifty for thirty others, one replaced
    assert found[1, day(2)] == pytest.approx(1 - 53 / 1_000_000, abs=1e-12)
    assert found[2, day(2)] == 0.0


def test_empty_equal_and_different_texts(command_rows, mixed):
    result = got(s.day_similarity(command_rows(mixed)))
    assert result[4, day(2)] == 1.0  # both empty
    assert result[4, day(4)] == 0.0  # empty against long
    assert (5, day(1)) not in result  # only a NULL command
    assert (result[5, day(2)], result[5, day(3)], result[5, day(4)]) == (1.0, 0.0, 1.0)


def test_first_session_only(spark, command_rows):
    rows = [(1, 1, 1, 0, "a"), (1, 1, 2, 9, "zzz"), (1, 2, 3, 0, "a"), (1, 2, 4, 9, "yyy")]
    commands = command_rows(rows)
    sessions = commands.groupBy("session_id", "user_id", "day").agg({"ts": "min"})
    sessions = sessions.withColumnRenamed("min(ts)", "start_ts")
    assert got(s.day_similarity_first_session(sessions, commands))[1, day(2)] == 1.0
    assert got(s.day_similarity(commands))[1, day(2)] < 1.0


def test_chunks_put_together_are_the_text(command_rows, mixed):
    commands = command_rows(mixed)
    for size in (7, 64, 10_000):
        parts = {}
        for r in ct.command_text(commands, ["user_id", "day"], size).collect():
            assert len(r.text) <= size
            parts.setdefault((r.user_id, r.day), []).append((r.chunk_no, r.text))
        joined = {k: "".join(t for _, t in sorted(v)) for k, v in parts.items()}
        want = {(u, day(n)): t for (u, n), t in day_texts(mixed).items()}
        assert joined == want
        for v in parts.values():
            assert sorted(no for no, _ in v) == list(range(len(v)))


def test_a_command_longer_than_a_chunk(command_rows):
    rows = [(1, 1, 1, 0, "a" * 50), (1, 1, 1, 1, "b" * 3), (1, 1, 1, 2, "")]
    out = ct.command_text(command_rows(rows), ["session_id"], 8).orderBy("chunk_no").collect()
    assert "".join(r.text for r in out) == "a" * 50 + " bbb "


def test_small_tiles_do_not_make_a_task_each():
    """A hundred million characters in tiles of 90 are tasks of some seconds, as in large tiles; a few are dealt over the cores."""
    assert s._tasks(100_000_000, 90, 12) == s._tasks(100_000_000, s.BLOCK_CHARS, 12) == 51
    assert s._tasks(1_000_000, 90, 12) == 12
    assert s._tasks(100, 90, 12) == 1
