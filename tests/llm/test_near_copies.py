"""Jaccard join, paragraph dedup and their helpers against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from userbaseline.llm import jaccard_join, links, paragraph_dedup, wordhash
from userbaseline.llm.jaccard_join import sketch_keys

from brute import components, shingles, words


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def edited(rnd, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.choice([3, 5, 9, 40, 120, 300]))) for i in range(120)]
    base = prose(rnd, 200)
    rows += [(1000 + i, base) for i in range(30)]  # copies
    rows += [(2000 + i, edited(rnd, base, rnd.randrange(1, 9))) for i in range(60)]  # near copies, some beyond the limit
    chain = prose(rnd, 100)
    for i in range(25):  # a chain whose ends are far apart
        rows.append((3000 + i, chain))
        chain = edited(rnd, chain, 2)
    passage = prose(rnd, 60)
    rows += [(4000 + i, prose(rnd, 60) + "\n" + passage) for i in range(40)]  # a common passage is no link
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One"), (5004, "one"), (5005, "a b"), (5006, "B\x1ca b")]
    rows += [(5010, "long " * 30000), (5011, "LONG " * 30000), (5012, "x" * 200000)]
    rows += [(5020, base), (5020, base), (None, base), (None, "nobody else says this at all")]
    return rows


def linked(sets, share=75):
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        i = len(x & y)
        if x and 100 * i >= share * (len(x) + len(y) - i):
            yield a, b


def test_components(documents, corpus):
    got = jaccard_join.jaccard_components(documents(corpus)).collect()
    assert len(got) == len(corpus)
    assert set(got[0].asDict()) == {"doc_id", "n_shingles", "component_id", "n_copies"}
    sets = {d: shingles(t) for d, t in corpus if d is not None}
    want = components(sets, linked(sets))
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    nameless = {r.n_shingles: r.component_id for r in got if r.doc_id is None}
    assert nameless == {196: 1000, 2: None}


def test_rounds_and_hot_group(documents, corpus, monkeypatch):
    """The star rounds and the last round give the same."""
    monkeypatch.setattr(links, "COMPARISONS", 0)
    want = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(corpus)).collect()}
    monkeypatch.setattr(links, "COMPARISONS", 10**9)
    monkeypatch.setattr(jaccard_join, "FETCH_BY_BROADCAST", 0)
    monkeypatch.setattr(jaccard_join, "ORDERED_SHINGLES", 1)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(corpus)).collect()}
    assert got == want


def test_first_of_each(documents):
    text = "one two three four five six seven"
    docs = documents([(3, text), (1, text.upper()), (2, "other"), (4, ""), (None, text), (5, None)])
    kept = jaccard_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 2), (False, 4), (False, 5), (True, 0)
    ]


def test_empty_table(documents, spark):
    docs = spark.createDataFrame([], documents([(1, "a")]).schema)
    assert jaccard_join.jaccard_components(docs).collect() == []
    assert paragraph_dedup.repeated_paragraphs(docs).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 90), st.integers(0, 40), st.integers(0, 40), st.randoms(use_true_random=False))
def test_linked_sketches_share_a_key(common, a, b, rnd):
    """Any pair within the limit meets in a key, whatever ranks the shingles have."""
    draw = lambda n: {rnd.getrandbits(64) for _ in range(n)}
    both, one, two = draw(common), draw(a), draw(b)
    x, y = sorted(both | one), sorted(both | two)
    if 100 * common < 75 * (common + a + b):
        return
    rank = {h: rnd.choice([0, 0, 5, 9]) for h in {*x, *y}}
    found = np.array(x + y, np.uint64)
    owner = np.array([0] * len(x) + [1] * len(y))
    keys = [set(), set()]
    for key, unit in sketch_keys(found, owner, 2, np.array([rank[h] for h in x + y]), 75, 100):
        for k, u in zip(key.tolist(), unit.tolist()):
            keys[u].add(k)
    assert keys[0] & keys[1]
    # and a key for each segment that may differ, not more than one band beyond
    assert len(keys[0]) <= 2 * (len(x) // 3 + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b\x1cé日.", max_size=30), min_size=1, max_size=8), st.integers(1, 7))
def test_words_of_slices(texts, chunk):
    old, wordhash.CHUNK_BYTES = wordhash.CHUNK_BYTES, chunk
    try:
        got = []
        for row, end, data, offsets in wordhash.slices(pa.array(texts), chunk * 3):
            found = wordhash.words(data, offsets)
            got += [(int(u) + row, bytes(data[s:e]).decode()) for u, s, e in zip(found.unit, found.start, found.end)]
    finally:
        wordhash.CHUNK_BYTES = old
    assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]


def test_paragraphs(documents):
    rnd = random.Random(3)
    passage, other = prose(rnd, 60), prose(rnd, 50)
    near = edited(rnd, passage, 1)
    short = "too short to be looked at"
    rows = [
        (1, f"{short}\n{passage}\nown {prose(rnd, 30)}"),
        (2, f"{prose(rnd, 25)}\n{passage.upper()}"),
        (3, f"{short}\n\n{near}\n{other}"),
        (4, f"{other}\n{prose(rnd, 40)}"),
        (5, prose(rnd, 500)), (6, None), (7, ""), (8, short), (8, short),
        (9, f"{other}\n{other}"), (9, f"{other}\n{other}"), (None, passage),
    ]
    docs = documents(rows)
    found = paragraph_dedup.repeated_paragraphs(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.paragraph, r.kept_doc_id, r.kept_paragraph) for r in found.collect())
    assert got == [
        (False, 2, 1, 1, 1), (False, 3, 2, 1, 1), (False, 4, 0, 3, 3), (False, 9, 0, 3, 3), (False, 9, 1, 3, 3),
        (True, 0, 0, 1, 1),
    ]
    kept = {(r.doc_id, r.text) for r in paragraph_dedup.remove_paragraphs(docs, found).collect()}
    assert (3, f"{short}\n\n{other}") in kept and (9, "") in kept and (None, "") in kept and (6, None) in kept
    assert (1, rows[0][1]) in kept and (5, rows[4][1]) in kept


def test_paragraphs_against_brute_force(documents):
    rnd = random.Random(11)
    bases = [prose(rnd, rnd.randrange(20, 120), 3000) for _ in range(15)]
    rows = []
    for d in range(120):
        parts = [edited(rnd, rnd.choice(bases), rnd.choice([0, 1, 1, 2, 9])) if rnd.random() < 0.5 else prose(rnd, 30, 3000) for _ in range(3)]
        rows.append((d, "\n".join(parts)))
    sets = {(d, p): shingles(x) for d, t in rows for p, x in enumerate(t.split("\n"))}
    want = components(sets, linked(sets))
    removed = {k: v for k, v in want.items() if k != v}
    got = {(r.doc_id, r.paragraph): (r.kept_doc_id, r.kept_paragraph) for r in paragraph_dedup.repeated_paragraphs(documents(rows)).collect()}
    assert got.keys() == removed.keys()
    assert got == removed


def test_passages_inside_lines_and_over_short_ones(documents):
    rnd = random.Random(23)
    own = lambda n: prose(rnd, n, 10**6)
    passage, spread, whole, loose = own(55), own(60).split(" "), own(70), own(49)
    short = "\n".join(" ".join(spread[i : i + 12]) for i in range(0, 60, 12))
    rows = [
        (1, f"{own(80)} {passage} {own(90)}\n{whole}"),
        (2, f"é日 {own(40)}\n{own(100)} {passage.upper()} {own(60)}\n{whole}"),  # inside another line
        (3, f"{own(8)}\n{short}\n{own(9)}"),
        (4, f"{own(30)}\n{' '.join(spread[:7])}\n{'  '.join(spread[7:])}\n{own(3)}"),  # other line breaks
        (5, f"{own(70)} {loose} {own(70)}"), (6, f"{own(70)} {loose} {own(70)}"),  # a word too few
        (7, f"{own(120)} {passage} {own(120)} {passage} {own(120)}"),  # twice more
        (8, None), (9, ""), (None, f"{own(150)} {passage} {own(150)}"),
        (10, "long " * 300), (2, None),
    ]
    docs = documents(rows)
    found = paragraph_dedup.repeats(docs)
    spans = [r for r in found.collect() if r.paragraph is None]
    texts = {d: t for d, t in rows if t}
    got = sorted((str(r.doc_id), words(texts[r.doc_id][r.start : r.end].lower()), r.n_words, r.kept_doc_id) for r in spans)
    p, s = passage.split(" "), spread
    assert got == [
        ("10", ["long"] * 299, 299, 10), ("2", p, 55, 1), ("4", s, 60, 3), ("7", p, 55, 1), ("7", p, 55, 1),
        ("None", p, 55, 1),
    ]
    assert all(texts[r.kept_doc_id][r.kept_start :].startswith(" ".join(words(texts[r.doc_id][r.start : r.end].lower())[:7])) for r in spans)
    kept = [r.text for r in paragraph_dedup.remove_repeats(docs, found).collect()]
    assert len(kept) == len(rows) and sum(t is None for t in kept) == 2
    assert sum(passage in (t or "").lower() for t in kept) == 1
    assert sum(" ".join(spread[:7]) in (t or "") for t in kept) == 1
    assert sum(whole in (t or "") for t in kept) == 1
    assert {rows[0][1], rows[2][1], rows[4][1], rows[5][1]} <= set(kept)


def test_passages_against_brute_force(documents):
    rnd = random.Random(31)
    sources = [prose(rnd, 200, 10**6).split(" ") for _ in range(4)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            source, at = rnd.choice(sources), rnd.randrange(150)
            parts += prose(rnd, 60, 10**6).split(" ") + source[at : at + rnd.randrange(30, 70)]
        rows.append((d, "".join(w + rnd.choice([" ", "  ", " ", "\n"]) for w in parts)))
    none = paragraph_dedup.repeated_paragraphs(documents([(0, "")]))
    first, want = {}, set()
    for d, t in rows:
        w = words(t)
        for at in range(len(w) - 49):
            window = tuple(w[at : at + 50])
            if first.setdefault(window, (d, at)) != (d, at):
                want |= {(d, i) for i in range(at, at + 50)}
    got = set()
    for r in paragraph_dedup.repeated_passages(documents(rows), none).collect():
        before = len(words(rows[r.doc_id][1][: r.start]))
        got |= {(r.doc_id, before + i) for i in range(r.n_words)}
    assert want and got == want


def test_band_recall():
    """20 bands of 4: of pairs at similarity 0.75 next to none is missed."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        both, one, two = (rng.integers(0, 2**64, n, np.uint64) for n in (60, 10, 10))
        found = np.concatenate([both, one, both, two])
        keys = paragraph_dedup.minhash_bands(found, np.repeat([0, 1], 70), 2)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 398


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in links.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_removal_touches_only_the_row_that_holds_the_repeat(documents):
    """Rows without an id, or with one and the same, are documents of their own if their texts differ."""
    line = " ".join(f"w{i}" for i in range(30))
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    for key in (None, 7):
        rows = [(key, f"{own[0]}\n{line}"), (key, f"{own[1]}\n{own[2]}"), (8, f"{line}\nshort"), (key, None), (key, "")]
        docs = documents(rows)
        held = paragraph_dedup.remove_repeats(docs, paragraph_dedup.repeats(docs)).collect()
        got = sorted(str((r.doc_id, r.text)) for r in held)
        stays = {None: [(None, own[0]), (8, f"{line}\nshort")], 7: [(7, f"{own[0]}\n{line}"), (8, "short")]}[key]
        assert got == sorted(map(str, [*stays, (key, f"{own[1]}\n{own[2]}"), (key, None), (key, "")]))


def test_many_stretches_are_cut_out_in_one_pass():
    text = "ä bc\n" * 100_000
    starts = list(range(0, len(text), 5))
    made = paragraph_dedup._without(text, starts, [s + 2 for s in starts], {0, 3})
    assert made == "bc\n" * 99_998
    assert paragraph_dedup._without("abcdef", [1, 2], [4, 3], set()) == "aef"
