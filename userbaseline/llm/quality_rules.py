"""Quality rules: base counts of each text, and outliers by a robust estimate of their group.

Base counts are taken over whole texts (words are runs outside ``\\x20 \\x09-\\x0D``): words and their code
points, signs ``#*$%&|<>``, lines with a word that equal an earlier line, and words inside 8-word windows
that are in the text twice or more. A text fails the base rules with fewer than 20 words or
over 30 percent of repeated words.

The other texts give a vector: log mean word length, and the arcsine roots of the shares of signs,
repeated lines and repeated words. Each language and source gets a minimum-covariance-determinant
estimate of it: starting from a median-and-quartile scale and from a tanh-damped covariance, concentration
steps take the ``KEPT_SHARE`` of rows with the smallest Mahalanobis distance and estimate
mean and covariance anew. A group's start goes on as long as a step lowers its determinant; the start with the
smaller determinant is used. A step that should still lower one after ``STEPS`` raises.

Most texts of a clean source have no signs or repetitions at all, so a covariance alone may be singular. What
is added to it is no fixed floor but the sampling error of the measures themselves: an arcsine root of a share among n units
has variance 1 / 4n, whatever the share, and the log of a mean of n word lengths ``WORD_SPREAD``² / n. The steps
add a group's mean of them; a text is judged by its group's covariance and its own errors, so that two
equal lines of five say less than two hundred of five hundred. A text whose squared distance is over ``CUTOFF`` is
rejected.

Groups with fewer than ``MIN_GROUP`` rows take their language's estimate, or that of all rows if the language
is small too; with fewer than ``MIN_GROUP`` rows altogether nothing is rejected by distance. Order statistics
come from counts per narrow bin, so a group of any size is never gathered; a group's rows stay spread.

Null texts have no words. A null language or source is a group of its own. Repeated rows count each.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from userbaseline.llm import wordhash as wh
from userbaseline.session import cut, ship

MIN_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
SIGNS = b"#*$%&|<>"

NAMES = ["x0", "x1", "x2", "x3"]
P = len(NAMES)
ERRORS = ["v0", "v1", "v2", "v3"]
#: standard deviation of the length of a text's words, as a share of their mean
WORD_SPREAD = 0.6
KEPT_SHARE = 0.75
#: makes the covariance of the central 75 percent that of all rows, for four normal measures
CONSISTENCY = 1.49
#: chi-square with four degrees of freedom, 0.99999
CUTOFF = 28.5
MIN_GROUP = 200
STEPS, SETTLED = 60, 1e-3
BIN = 1e-3  # width of the bins for quartiles; distances are binned by 1/64 of a doubling

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_is_sign = np.zeros(256, bool)
_is_sign[list(SIGNS)] = True
_starts_character = (np.arange(256) & 0xC0) != 0x80
BLANKS = b" \t\n\x0b\x0c\r"


def _repeated_words(word: wh.Words, units: int) -> np.ndarray:
    """Words of each unit that stand in a window found at least twice in it."""
    n = len(word.hash)
    out = np.zeros(units, np.int64)
    if n < WINDOW:
        return out
    found, owner = wh.windows(word, WINDOW, units, short=False)
    first = np.flatnonzero(word.unit[: n - WINDOW + 1] == word.unit[WINDOW - 1 :])
    order = np.lexsort((found, owner))
    same = (found[order][1:] == found[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(found), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    begin = first[twice]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(word.unit[covered], minlength=units)


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The columns of `COUNTS` for an array of texts without nulls."""
    parts = []
    for row, end, data, offsets in wh.slices(texts):
        units = end - row
        word = wh.words(data, offsets)
        sums = np.append(0, np.cumsum(_starts_character[data], dtype=np.int64))
        chars = np.bincount(word.unit, sums[word.end] - sums[word.start], minlength=units).astype(np.int64)
        sums = np.append(0, np.cumsum(_is_sign[data], dtype=np.int64))
        signs = sums[offsets[1:]] - sums[offsets[:-1]]
        dups, lines = np.zeros(units, np.int64), np.zeros(units, np.int64)
        raw = data.tobytes()
        for u in range(units):
            every = raw[offsets[u] : offsets[u + 1]].split(b"\n")
            lines[u] = len(every)
            if len(set(every)) < len(every):
                worded = [x for x in every if x.strip(BLANKS)]
                dups[u] = len(worded) - len(set(worded))
        parts.append([np.bincount(word.unit, minlength=units), chars, signs, dups, _repeated_words(word, units), lines])
    if not parts:
        return [np.zeros(0, np.int64) for _ in COUNTS]
    return [np.concatenate(x) for x in zip(*parts)]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lang, source, text = batch.columns
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), lang, source, *[pa.array(x.astype(np.int64)) for x in text_counts(text)]],
            ["doc_id", "lang", "source", *COUNTS],
        )


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and base_failed."""
    ship(docs.sparkSession)
    rows = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.mapInArrow(_count_rows, schema).withColumn("base_failed", failed)


def _measures() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))

    def share(part: str, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.col(part) / whole, F.lit(1.0))))

    made = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        share("n_symbols", F.greatest(F.col("word_chars"), F.lit(1))),
        share("n_dup_lines", F.col("n_lines")),
        share("n_repeat_words", words),
    ]
    return [m.alias(name) for m, name in zip(made, NAMES)]


def _errors() -> list[Column]:
    """The sampling variance of each measure. Repeated words come in windows, so as many units are one."""

    def over(count: str) -> Column:
        return F.greatest(F.col(count), F.lit(1)).cast("double")

    made = [
        F.lit(WORD_SPREAD**2) / over("n_words"),
        F.lit(0.25) / over("word_chars"),
        F.lit(0.25) / over("n_lines"),
        F.lit(0.25 * WINDOW) / over("n_words"),
    ]
    return [m.alias(name) for m, name in zip(made, ERRORS)]


def _moments(rows: DataFrame, values: list[Column]) -> DataFrame:
    """(grp, start, n, s, q): count, sums and sums of products of ``values``."""
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    return rows.groupBy("grp", "start").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(v) for v in values]).alias("s"),
        F.array(*[F.sum(values[i] * values[j]) for i, j in pairs]).alias("q"),
    )


def _symmetric(q: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    out[np.triu_indices(P)] = q
    return out + np.triu(out, 1).T


def _estimates(spread: bool):
    """Moments with their group's centre, scale and mean errors to (mean, covariance, inverse of the covariance with
    the errors, its log determinant), a row for each group.

    With ``spread`` the moments are of tanh-damped standard values.
    """
    schema = "grp string, start int, mean array<double>, cov array<double>, inverse array<double>, logdet double"
    types = [pa.string(), pa.int32(), *[pa.list_(pa.float64())] * 3, pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array(r["s"]) / r["n"]
                cov = _symmetric(np.array(r["q"])) / r["n"] - np.outer(mean, mean)
                if spread:
                    scale = np.array(r["scale"])
                    cov, mean = cov * np.outer(scale, scale), np.array(r["centre"])
                    if r["start"] == 0:
                        cov = np.diag(scale**2)
                else:
                    cov = cov * CONSISTENCY
                whole = cov + np.diag(r["errors"])
                logdet = float(np.linalg.slogdet(whole)[1])
                out.append((r["grp"], r["start"], mean.tolist(), cov.ravel().tolist(), np.linalg.inv(whole).ravel().tolist(), logdet))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "start", "mean", "cov", "inverse", "logdet"])

    return run, schema


def _distance() -> Column:
    """Squared Mahalanobis distance of the measures from ``mean`` by ``inverse``."""
    d = [F.col(x) - F.get("mean", F.lit(i)) for i, x in enumerate(NAMES)]
    terms = [d[i] * d[j] * F.get("inverse", F.lit(i * P + j)) for i in range(P) for j in range(P)]
    return sum(terms[1:], terms[0])


def _upto(binned: DataFrame, keys: list[str], share: Column, name: str) -> DataFrame:
    """For each key the least bin up to which at least ``share`` of its rows lie."""
    counted = binned.groupBy(*keys, "bin").agg(F.count("*").alias("k"))
    ordered = Window.partitionBy(*keys).orderBy("bin")  # bins, of bounded number, not rows
    whole = Window.partitionBy(*keys)
    counted = counted.select(*keys, "bin", F.sum("k").over(ordered).alias("sofar"), F.sum("k").over(whole).alias("all"))
    return counted.filter(F.col("sofar") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias(name))


def _scales(rows: DataFrame) -> DataFrame:
    """(grp, centre, scale, errors): medians, quartile scales and mean errors of each group's measures."""
    flat = rows.select("grp", F.posexplode(F.array(*NAMES)).alias("dim", "x"))
    binned = flat.select("grp", "dim", F.floor(F.col("x") / BIN).alias("bin"))
    quartiles = None
    for name, share in (("low", 0.25), ("mid", 0.5), ("high", 0.75)):
        found = _upto(binned, ["grp", "dim"], F.lit(share), name)
        quartiles = found if quartiles is None else quartiles.join(found, ["grp", "dim"])
    errors = rows.groupBy("grp").agg(F.array(*[F.avg(v) for v in ERRORS]).alias("errors"))
    scale = F.greatest((F.col("high") - F.col("low")) * BIN / 1.349, F.sqrt(F.get("errors", F.col("dim"))))
    entry = F.struct("dim", ((F.col("mid") + 0.5) * BIN).alias("centre"), scale.alias("scale"))
    met = quartiles.join(errors, "grp").groupBy("grp").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.first("errors").alias("errors"))
    return met.select("grp", F.col("e.centre").alias("centre"), F.col("e.scale").alias("scale"), "errors")


def _starts(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """The two starting estimates of each group."""
    met = rows.join(scales, "grp").withColumn("start", F.lit(0))
    damped = [
        F.tanh((F.col(x) - F.get("centre", F.lit(i))) / F.get("scale", F.lit(i))) for i, x in enumerate(NAMES)
    ]
    moments = _moments(met, damped).drop("start").join(scales, "grp")
    return moments.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))).mapInArrow(*_estimates(True))


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """(grp, mean, cov) for the groups of ``rows`` (grp, the measures and their errors)."""
    scales = cut(_scales(rows))
    estimates = cut(_starts(rows, scales))
    settled = None
    for step in range(STEPS):
        near = rows.join(estimates.select("grp", "start", "mean", "inverse"), "grp")
        near = near.withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * 64))
        within = _upto(near, ["grp", "start"], F.lit(KEPT_SHARE), "most")
        central = near.join(within, ["grp", "start"]).filter("bin <= most")
        moments = _moments(central, [F.col(x) for x in NAMES]).join(scales, "grp")
        after = moments.mapInArrow(*_estimates(False))
        if step == 0:  # determinants of the starts are of other rows, and say nothing
            estimates = cut(after)
            continue
        was = estimates.select("grp", "start", F.col("logdet").alias("was"))
        after = cut(after.join(was, ["grp", "start"]).withColumn("lower", F.col("logdet") < F.col("was") - SETTLED))
        done = estimates.join(after.filter("not lower").select("grp", "start"), ["grp", "start"], "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        estimates = after.filter("lower").drop("was", "lower")
        if estimates.isEmpty():
            break
    else:
        raise ArithmeticError(f"{estimates.count()} estimates have not settled in {STEPS} steps")
    best = settled.groupBy("grp").agg(F.min(F.struct("logdet", "start", "mean", "cov")).alias("b"))
    return best.select("grp", F.col("b.mean").alias("mean"), F.col("b.cov").alias("cov"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their group's estimate to rows with their distance; null without an estimate."""
    given = [*NAMES, *ERRORS, "mean", "cov"]
    for batch in batches:
        has = batch.column("mean").is_valid()
        known = batch.filter(has)
        x, v = (np.stack([known.column(c).to_numpy() for c in names], 1) for names in (NAMES, ERRORS))
        mean = np.asarray(known.column("mean").flatten()).reshape(-1, P)
        cov = np.asarray(known.column("cov").flatten()).reshape(-1, P, P)
        apart = x - mean
        solved = np.linalg.solve(cov + v[:, :, None] * np.eye(P), apart[:, :, None])[:, :, 0]
        out = np.full(batch.num_rows, np.nan)
        out[has.to_numpy(zero_copy_only=False)] = (apart * solved).sum(1)
        yield batch.drop_columns(given).append_column("distance", pa.array(out, from_pandas=True))


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, base counts, base_failed, distance (null without an estimate) and kept."""
    counts = cut(base_counts(docs))
    rows = counts.filter("not base_failed").select(
        F.to_json(F.struct("lang", "source")).alias("own"), F.to_json(F.struct("lang")).alias("wider"), *_measures(), *_errors()
    )
    # the group whose estimate serves a language and source: itself, its language, or all
    sizes = rows.groupBy("own", "wider").agg(F.count("*").alias("n"))
    wider = sizes.groupBy("wider").agg(F.sum("n").alias("m"))
    whole = sizes.agg(F.sum("n").alias("w"))
    serves = sizes.join(wider, "wider").crossJoin(F.broadcast(whole)).select(  # one row
        "own", "wider",
        F.when(F.col("n") >= min_group, F.col("own")).when(F.col("m") >= min_group, F.col("wider"))
        .when(F.col("w") >= min_group, F.lit("all")).alias("grp"),
    )
    serves = cut(serves)
    wanted = [r.grp for r in serves.select(F.when(F.col("grp") == "all", "all").when(F.col("grp") == F.col("wider"), "wider").when(F.col("grp") == F.col("own"), "own").alias("grp")).distinct().collect() if r.grp]
    levels = []
    if "own" in wanted:
        chosen = serves.filter("grp = own").select("own")
        levels.append(rows.join(chosen, "own", "left_semi").withColumn("grp", F.col("own")))
    if "wider" in wanted:
        chosen = serves.filter("grp = wider").select("wider").distinct()
        levels.append(rows.join(chosen, "wider", "left_semi").withColumn("grp", F.col("wider")))
    if "all" in wanted:
        levels.append(rows.withColumn("grp", F.lit("all")))
    shown = counts.select("*", F.to_json(F.struct("lang", "source")).alias("own"), *_measures(), *_errors())
    columns = ["doc_id", "lang", "source", *COUNTS, "base_failed"]
    if not levels:
        return shown.select(*columns, F.lit(None).cast("double").alias("distance"), (~F.col("base_failed")).alias("kept"))
    pool = levels[0]
    for more in levels[1:]:
        pool = pool.unionByName(more)
    estimates = minimum_covariance(cut(pool.select("grp", *NAMES, *ERRORS)))
    params = serves.join(estimates, "grp").select("own", "mean", "cov")
    met = shown.join(params, (shown.own == params.own) & ~F.col("base_failed"), "left")
    met = met.select(*columns, *NAMES, *ERRORS, "mean", "cov")
    judged = met.mapInArrow(_judge, met.select(*columns).schema.add("distance", "double"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.select(*columns, "distance", kept.alias("kept"))
