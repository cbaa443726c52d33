"""The Merkle manifest, the pair index and the alignment against plain versions and the libraries."""

import collections
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("regex")
P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from brute import sha  # noqa: E402

from userbaseline.llm import merkle_manifest, pair_index_bpe, token_alignment  # noqa: E402

BYTE_BPE, PIECE_BPE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD_TEXTS = [
    None, "", "a", " ", "\n\n \t", "a" * 3000, "aaaa aaa aa", "  two  blanks <|endoftext|><|endoftext|> <|endoftext",
    "é漢字▁under \x85\xa0　 \x1c\x1f \x00", "I'll 'LL ''s 12 345", "\N{WOMAN}‍\N{MICROSCOPE} é", "<s> </s> <0x41> <unk>",
]


def random_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "漢", "1", "'s", "<|endoftext|>", "!", "ab ab", " under", "▁"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(n)]


# --- Merkle manifest


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    """(source, doc_id, position, leaf, subroot, root, siblings joined) of (doc_id, text, lang, source, n_chars)."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[source].append((doc_id is not None, doc_id or 0, sha("".join(map(value, (doc_id, source, lang, n_chars, text)))), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for s in order:
        for i, (_, _, leaf, doc_id) in enumerate(sorted(groups[s])):
            beside = ""
            for levels, k in ((trees[s], i), (upper, order.index(s))):
                for level in levels[:-1]:
                    first = k // 16 * 16
                    beside += "".join(level[first:k] + level[k + 1 : first + 16])
                    k //= 16
            out.append((s, doc_id, i, leaf, trees[s][-1][0], upper[-1][0], sha(beside)))
    return out


def manifest_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, grp string, word string, at int, slots int"
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], schema).repartition(3)
    held = merkle_manifest.manifest(docs)
    names = ["source", "doc_id", "position", "leaf", "subroot", "root"]
    folded = merkle_manifest.folded_root(F.col("leaf"), F.col("path")).alias("folded")
    got = held.select(*names, F.sha2(merkle_manifest.proof(F.col("path")), 256).alias("said"), folded).collect()
    assert all(r.folded == r.root for r in got)
    return [tuple(r)[:7] for r in got]


def same_rows(got, want):
    return sorted(map(str, got)) == sorted(map(str, want))


def test_manifest_with_odd_rows(spark):
    rnd = random.Random(3)
    ids = [rnd.randrange(-(10**6), 10**6) for _ in range(400)] + [*range(300), 63, 64, -64, -1, 0, 2**62, -(2**62)]
    ids += [None] * 7 + [5] * 40 + [9] * 3  # null and repeated ids, among them equal rows
    sources = ["s1", None, "", "é", "Z"] + ["hot"] * 8
    rows = [(i, rnd.choice(["a", "b", None, "", "Ü" * 999]), rnd.choice(["en", None]), rnd.choice(sources), rnd.choice([None, 3])) for i in ids]
    assert same_rows(manifest_rows(spark, rows), plain_manifest(rows))


@pytest.mark.parametrize("n, sources", [(0, 1), (1, 1), (17, 1), (16, 1), (40, 40), (300, 2)])
def test_manifest_of_any_shape(spark, n, sources):
    rows = [(i, f"text {i}", "en", f"s{i % sources}", 1) for i in range(n)]
    assert same_rows(manifest_rows(spark, rows), plain_manifest(rows))


def test_equal_rows_are_laid_out_in_steps(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "_COPIES", 4)
    rows = [(1, "a", "en", "s", 1)] * 21 + [(2, "b", "en", "s", 1), (None, "c", None, "s", None)]
    assert same_rows(manifest_rows(spark, rows), plain_manifest(rows))


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", "en", "s", 1) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.when(F.col("doc_id") == 7, F.lower("text")).otherwise(F.col("text"))
    held = merkle_manifest.manifest(docs, {"found": merkle_manifest.leaf_hash(*values, text)})
    wrong = held.filter(merkle_manifest.folded_root(F.col("found"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [7]


# --- pair index


def test_pair_index_gives_the_librarys_ids(spark, documents):
    texts = [*ODD_TEXTS, *random_texts(400, 1)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    docs = documents(rows)
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    for special in (True, False):
        library.encode_special_tokens = not special
        made = pair_index_bpe.encode_rows(docs, BYTE_BPE, special=special)
        want = []
        for doc_id, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            packed = b"".join(i.to_bytes(4, "little") for i in ids)
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), sha(decoded), ids))
        got = [tuple(r) for r in made.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        back = [(r.doc_id, r.text) for r in pair_index_bpe.decode_rows(made, BYTE_BPE).collect()]
        assert sorted(map(str, back)) == sorted(str((i, t or "")) for i, t in rows)
    assert pair_index_bpe.encode_rows(spark.createDataFrame([], docs.schema), BYTE_BPE).count() == 0


def test_bounds_of_portions_and_pieces_change_nothing():
    with open(BYTE_BPE, "rb") as file:
        vocabulary = pair_index_bpe.Vocabulary(file.read())
    texts = random_texts(200, 2) + ["word%d" % i for i in range(200)]
    whole, counts = pair_index_bpe.Codec(vocabulary).encode(texts)
    tight = pair_index_bpe.Codec(vocabulary, pieces=20)
    parts = [tight.encode(texts[i : i + 7])[0] for i in range(0, len(texts), 7)]
    assert [x for p in parts for x in p.tolist()] == whole.tolist()
    assert counts.sum() == len(whole)


def test_one_very_long_word():
    """A word of a megabyte, all of one letter or of two, is one piece of the index."""
    with open(BYTE_BPE, "rb") as file:
        codec = pair_index_bpe.Codec(pair_index_bpe.Vocabulary(file.read()))
    for text in ("a" * 1_000_000, "ab" * 500_000):
        ids, _ = codec.encode([text])
        assert codec.decode(ids) == text
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    assert codec.encode(["ab" * 5000])[0].tolist() == library.encode("ab" * 5000).ids


def test_pairs_that_come_up_again_with_a_lower_rank():
    """A merge may make a pair whose rank is below its own."""
    vocabulary = pair_index_bpe.Vocabulary.__new__(pair_index_bpe.Vocabulary)
    import numpy as np

    # ids: a 0, b 1, c 2, ab 3, abc 4, bc 5; ranks: (ab)c 0, ab 1, bc 2
    vocabulary.first = np.zeros(256, np.int32)
    vocabulary.first[[97, 98, 99]] = [0, 1, 2]
    vocabulary.left, vocabulary.right = np.array([3, 0, 1]), np.array([2, 1, 2])
    vocabulary.made = np.array([4, 3, 5], np.int32)
    keys = vocabulary.left * pair_index_bpe._WIDE + vocabulary.right
    order = np.argsort(keys)
    vocabulary.keys, vocabulary.ranks = keys[order], order.astype(np.int32)
    ids, counts = pair_index_bpe.PairIndex(vocabulary, [b"abc", b"", b"bcab", b"aabc"]).run()
    assert (ids.tolist(), counts.tolist()) == ([4, 5, 3, 0, 4], [1, 0, 2, 2])


# --- alignment


def plain_alignment(rows):
    a = tokenizers.Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    character = {v: k for k, v in pair_index_bpe.byte_characters().items()}
    byte_of = {c: n for n, c in character.items()}
    held, in_docs = [], collections.Counter()
    for doc_id, text in rows:
        a_ids = a.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = b.encode(text or "")
        a_parts = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids]
        b_parts = []
        for i in b_ids:
            piece = b.id_to_piece(i)
            b_parts.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            held.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, parts in ((a_ids, a_parts), (b_ids, b_parts)):
            at, own = 0, []
            for i, p in zip(ids, parts):
                own.append((i, at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        borders = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, low = [], 0
        for high in borders:
            groups.append("|".join(",".join(str(i) for i, s, e in own if low <= s < high) for own in spans))
            low = high
        in_docs.update(set(links))
        held.append((doc_id, a_ids, b_ids, groups, links))
    most = collections.Counter()
    for (x, _), n in in_docs.items():
        most[x] = max(most[x], n)
    return [
        (doc_id, len(x), len(y), len(g), len(links), sum(in_docs[p] == most[p[0]] for p in links),
         sum(in_docs[p] for p in links), sha(";".join(g)) if g else "")
        for doc_id, x, y, g, links in held
    ]


@pytest.mark.parametrize("block", [50, 10**6])
def test_alignment_against_all_pairs_of_tokens(spark, documents, block):
    texts = [*ODD_TEXTS[:5], *ODD_TEXTS[6:], *random_texts(150, 5), "same text", "same text"]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)]
    docs = documents(rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = token_alignment.alignment(docs, BYTE_BPE, PIECE_BPE, block).select(*names).collect()
    want = plain_alignment(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(w[1] > w[3] > 0 for w in want) and any(t and not w[1] for (_, t), w in zip(rows, want))
    shown = {r.doc_id: sha(r.groups) if r.groups else "" for r in token_alignment.groups(docs, BYTE_BPE, PIECE_BPE).collect()}
    assert all(shown[w[0]] == w[7] for w in want if w[0] is not None)
    assert token_alignment.alignment(spark.createDataFrame([], docs.schema), BYTE_BPE, PIECE_BPE).count() == 0


def test_a_block_is_aligned_a_few_texts_at_a_time():
    """Beside their links, a block's texts need the memory of a part of them."""
    import tracemalloc

    import numpy as np

    with open(BYTE_BPE, "rb") as a, open(PIECE_BPE, "rb") as b:
        aligner = token_alignment.Aligner(a.read(), b.read())
    texts = ["a long text of plain words " * 100 + str(i) for i in range(300)] + ["", "tail"]
    want = [aligner.shown_groups(made, 1)[0] for t in texts for _, made, *_ in aligner.parts([t])]
    tracemalloc.start()
    got, links, tokens, most = [], [], 0, 0
    for first, made, n_a, n_b in aligner.parts(texts):
        assert len(got) == first
        got += aligner.shown_groups(made, len(n_a))
        links.append(made.link_doc + first)
        tokens, most = tokens + len(made.token), max(most, len(made.token))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and tokens == sum(len(re.split("[,|;]", g)) for g in want if g)
    assert np.all(np.diff(np.concatenate(links)) >= 0)
    assert most < tokens / 5
    assert peak < 30 * sum(map(len, texts))


def test_queries_give_the_contracts_columns(spark):
    from userbaseline.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(30).collect()]
    made = {r.doc_id: r for r in queries.op12_pair_index_bpe(spark, folder).collect()}
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert made[doc_id].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert made[doc_id].decoded_sha256 == sha(text)
