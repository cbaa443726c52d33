"""Quality of texts by logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Tokens are runs of letters and digits or runs of signs, A-Z kept apart from a-z; unigrams and
bigrams are hashed to ``DIMENSIONS`` weights, a token said twice as the same bigram for all tokens. A text's features are its n-gram frequencies, so its
score is a sparse dot product: the mean weight of its n-grams (times ``SCALE``), plus a bias, through
the logistic function. A text without tokens scores the bias alone.

Training reads at most ``MAX_TRAINED`` labelled rows (those with the smallest hash of their id); they are
dealt by hash over ``SHARDS`` tasks, each runs ``EPOCHS`` passes of follow-the-regularised-leader over
its rows in hash order, and the shards' weights are averaged. The weights, of fixed number, are the only
thing that reaches the driver. Without labelled rows every score is 0.5.

Null texts are empty. Labels other than 0 and 1 and null ids are left out of training; of several
labels for an id the largest counts; repeated rows train as often as they are there. All other columns
pass through `with_score`, which replaces columns named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from userbaseline.llm import wordhash as wh
from userbaseline.session import ship

DIMENSIONS = 1 << 18
SCALE = 8.0
#: hash of all bigrams that say a token twice, whichever it is
AGAIN = np.uint64(0x5BD1E995_9E3779B9)
MAX_TRAINED = 20_000
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5


def held_out(doc_id: Column) -> Column:
    """True for rows that must not be trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight number, unit) of all unigrams and bigrams, by unit."""
    word = wh.words(data, offsets, kinds=wh.SIGNS)
    units = len(offsets) - 1
    pairs, owner = wh.windows(word, 2, units, short=False)
    again = word.hash[1:] == word.hash[:-1]
    pairs[again[word.unit[1:] == word.unit[:-1]]] = AGAIN
    every = np.concatenate([word.hash, pairs])
    unit = np.concatenate([word.unit, owner])
    order = np.argsort(unit, kind="stable")
    return (every[order] >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64), unit[order]


def _texts(column: pa.Array) -> pa.Array:
    return column.fill_null("") if column.null_count else column


class Ftrl:
    """FTRL-proximal logistic regression over sparse features; weight 0 is the bias's own last place."""

    def __init__(self):
        self.z = np.zeros(DIMENSIONS + 1)
        self.n = np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for batch in batches:
        order, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for row, end, data, offsets in wh.slices(_texts(batch.column(0))):
            number, unit = _grams(data, offsets)
            bounds = np.searchsorted(unit, np.arange(end - row + 1))
            for k in range(end - row):
                own = number[bounds[k] : bounds[k + 1]]
                at, times = np.unique(own, return_counts=True)
                x = np.append(SCALE * times / max(len(own), 1), 1.0)
                rows.append((order[row + k], np.append(at, DIMENSIONS).astype(np.int32), x.astype(np.float32), labels[row + k]))
    rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
    model = Ftrl()
    for _ in range(EPOCHS):
        for _, at, x, y in rows:
            model.learn(at, x.astype(np.float64), y)
    if rows:
        w = model.weights(np.arange(DIMENSIONS + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(w[at]), pa.array(np.full(len(at), len(rows), np.int64))], ["at", "w", "n"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1]), pa.array([0.0]), pa.array([len(rows)], pa.int64())], ["at", "w", "n"]
        )


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_trained: int = MAX_TRAINED) -> np.ndarray:
    """The weights, the bias last. ``use`` says which labelled rows, by ``doc_id``, may be learnt from."""
    ship(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(use) if use is not None else known
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = known.select("doc_id", "label", F.xxhash64("doc_id").alias("draw")).orderBy("draw").limit(max_trained)
    # at most max_trained ids and labels: small by its own bound
    drawn = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    dealt = drawn.select("text", "draw", "label").repartition(SHARDS, F.pmod("draw", F.lit(SHARDS)))
    made = dealt.mapInArrow(_train_shard, "at long, w double, n long")
    # every shard counts by its rows; its row -1 tells how many they are
    total = made.groupBy("at").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n")).toArrow()
    at, w, n = (total.column(i).to_numpy() for i in range(3))
    weights = np.zeros(DIMENSIONS + 1)
    if len(at):
        weights[at[at >= 0]] = w[at >= 0] / n[at < 0][0]
    return weights


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for row, end, data, offsets in wh.slices(_texts(texts)):
        number, unit = _grams(data, offsets)
        total = np.bincount(unit, weights[number], minlength=end - row)
        count = np.bincount(unit, minlength=end - row)
        out[row:end] = SCALE * total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(out + weights[DIMENSIONS], -35, 35)))


def with_score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with a column ``score``: how likely the text's label is 1."""
    ship(docs.sparkSession)
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    text = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scores(batch.column(text), sent.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "score"])

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)(list(schema.fields)).add("score", "double"))
