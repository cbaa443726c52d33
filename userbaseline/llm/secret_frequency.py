"""Secrets in texts, and how widely each is copied over the corpus; DataFrame operations only.

Base kinds (leftmost, non-overlapping per kind; matches that fail the length test are dropped):

* ``assign``: a password-like name, ``:`` or ``=``, and a value of 8 or more characters
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters together
* ``hex``: 32 or more digits 0-9a-f

Method: the hash of each candidate's value is counted over the whole corpus by distinct repositories
(documents, unless another column is named) and distinct owners. A value of at least
``copied_owners`` owners or ``copied_repositories`` repositories is a widely copied example; others are
owner-specific and look live. Two
further kinds, ``token`` (prefixed service tokens) and ``mixed`` (long strings of small letters, capitals
and digits), are too weak to stand alone: their spans are added only where the value is
owner-specific and no span of an earlier kind covers them.

Texts are scanned once; what is shuffled is candidates, by the hash of their value, after distinct
(value, owner) pairs are made in the map tasks. Places are running sums over a text's
matches, so what it costs grows with its length and its matches. Null or empty texts have no candidates. A null owner
counts as one owner. Repeated rows are documents of their own in the result and one in the counts.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from userbaseline.session import cut

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run is matched whole, so the shorter ones can be left out at once
TOKEN = r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-)[A-Za-z0-9_-]{16,}"
MIXED = r"[A-Za-z0-9+/_-]{24,}"

#: kinds in the order in which spans of one start are listed
KINDS = ["assign", "access", "hex", "token", "mixed"]
BASE = KINDS[:3]
COPIED_OWNERS = 3
#: one owner may keep a live value in some documents of their own, but not in this many
COPIED_REPOSITORIES = 20


def _matches(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """array<struct<kind, pos, gap, size, value, counts>> of the matches of ``pattern``.

    The pieces between matches and the matches themselves come in turn: ``gap`` is the length of the piece before the match.
    ``counts`` is false for a match that is too short to be a candidate, and only moves those after it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), value.alias("value"))

    def shown(m: Column, pos: Column) -> Column:
        counts = F.char_length(m.value) >= least
        if KINDS[kind] == "mixed":
            counts = counts & _looks_random(m.value)
        return F.struct(
            F.lit(kind).alias("kind"), pos.alias("pos"), m.gap.alias("gap"), F.char_length(m.hit).alias("size"),
            m.value.alias("value"), counts.alias("counts"),
        )

    # the last piece has no match after it
    found = F.transform(F.filter(zipped, lambda m: m.hit.isNotNull()), shown)
    none = F.expr("cast(array() AS array<struct<kind: int, pos: int, gap: int, size: int, value: string, counts: boolean>>)")
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, owner, repository, matches) with the matches of all kinds in each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(owner).alias("owner"), F.col(repository).alias("repository"), text.alias("text"))
    kinds = [
        _matches(F.col("text"), ASSIGN, 0, 8, 2),
        _matches(F.col("text"), ACCESS, 1, 16),
        _matches(F.col("text"), HEX, 2, 32),
        _matches(F.col("text"), TOKEN, 3, 20),
        _matches(F.col("text"), MIXED, 4, 24),
    ]
    return rows.select("doc_id", "owner", "repository", F.concat(*kinds).alias("matches"))


def _looks_random(value: Column) -> Column:
    kinds = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return kinds & (F.size(F.array_distinct(F.split(value, ""))) >= 12)


def secret_spans(
    docs: DataFrame,
    owner: str = "source",
    repository: str = "doc_id",
    copied_owners: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans), spans (all), n_copied and n_specific.

    Spans are array<struct<start, kind, end>>, kind an index into `KINDS`.
    """
    rows = cut(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    found = rows.filter(F.size("matches") > 0).select("row", "owner", "repository", F.inline("matches"))
    found = found.withColumn("value", F.sha2("value", 256))
    each = found.filter("counts").select("value", "owner", "repository")
    # distinct (value, owner) and (value, repository) first: a value in a third of all rows stays small
    owners = each.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    repositories = each.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    spread = owners.join(repositories, "value")
    # code points: what lies before a match is the sum of the gaps and matches before it
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).filter("counts")
    placed = placed.select("row", "value", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    judged = placed.join(spread, "value")
    # covered by a span of an earlier kind that starts no later and ends no earlier
    sofar = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = [F.max(F.when(F.col("kind") < k, F.col("end"))).over(sofar) for k in (3, 4)]
    covered = F.when(F.col("kind") == 3, reach[0] >= F.col("end")).when(F.col("kind") == 4, reach[1] >= F.col("end"))
    judged = judged.withColumn("covered", F.coalesce(covered, F.lit(False)))
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"), "owners", "repositories", "covered")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))
    met = rows.select("doc_id", "row").join(per_row, "row", "left")
    none = F.expr("cast(array() AS array<struct<start: bigint, kind: int, end: bigint, owners: bigint, repositories: bigint, covered: boolean>>)")
    met = met.select("doc_id", F.coalesce("all", none).alias("all"))
    met = met.select("doc_id", "all", F.filter("all", lambda s: s.kind < len(BASE)).alias("base"))

    def copied(s: Column) -> Column:
        return (s.owners >= copied_owners) | (s.repositories >= copied_repositories)

    def added(s: Column) -> Column:
        return (s.kind < len(BASE)) | (~copied(s) & ~s.covered)

    met = met.select("doc_id", "all", "base", F.filter("all", added).alias("spans"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return met.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        "base",
        "spans",
        F.size(F.filter("spans", copied)).cast("long").alias("n_copied"),
        F.size(F.filter("spans", lambda s: ~copied(s))).cast("long").alias("n_specific"),
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end))
    return F.array_join(shown, ",")
