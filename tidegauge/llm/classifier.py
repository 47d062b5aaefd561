"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins. Tables grow by boosting in
cycles: for one feature after the other, a shallow tree over its bins is fitted
to the residuals of all tables so far and added with a small rate. Pairs of
features whose four quadrants explain most of what is left get tables over both
bins in the same way. A score is the sum of a few table entries.

The model is fitted on a bounded sample of labelled rows; every row is scored.
A null or empty text has all features 0 and gets their score. Without any labels
every score is 0.5. Rows are scored one by one, so ties and repeated rows get equal
scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bounded_sample, map_arrow, query, table, text_of
from tidegauge.session import materialise

#: Documented bound: labelled rows the model is fitted on, chosen by a hash of doc_id.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
CYCLES, PAIR_CYCLES, RATE, LEAVES = 120, 40, 0.1, 4
#: A score from here on predicts good quality.
GOOD = 0.7
HELD_OUT = 2
FEATURES = [
    "words", "word_length", "symbols", "capitals", "exclamations", "digits", "dup_lines", "stutter", "distinct",
    "line_words", "commas", "ends", "long_words", "opens",
]


def features(text: str) -> tuple:
    """Shares and lengths that say how a text is written, in the order of `FEATURES`."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        float(np.log1p(n)), chars / n, sum(text.count(c) for c in "#*$%&|<>") / n, sum(len(w) > 2 and w.isupper() for w in words) / n,
        text.count("!") / n, sum(map(str.isdigit, text)) / chars, 1 - len(set(lines)) / len(lines), sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(words)) / n, float(np.log1p(n / len(lines))), text.count(",") / n, text.count(".") / n,
        sum(len(w) > 12 for w in words) / n, sum(w[0].isupper() for w in words) / n,
    )


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every row."""

    def rows(batch):
        return {"doc_id": batch.column(0), "features": [list(features(t)) for t in batch.column(1).to_pylist()]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), rows, "doc_id long, features array<double>")


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Best steps over ordered bins: up to `LEAVES` leaves, split where the gain is largest."""
    parts, total_g, total_w = [(0, len(gradient))], np.cumsum(np.append(0, gradient)), np.cumsum(np.append(0, weight))

    def value(a, b):
        return (total_g[b] - total_g[a]) ** 2 / (total_w[b] - total_w[a] + 1.0)

    while len(parts) < LEAVES:
        best = (1e-9, None, None)
        for a, b in parts:
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = value(a, cuts) + value(cuts, b) - value(a, b)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (a, b), int(cuts[at]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(gradient))
    for a, b in parts:
        step[a:b] = (total_g[b] - total_g[a]) / (total_w[b] - total_w[a] + 1.0)
    return step


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Best single cut of both axes: its gain, and the step of the four quadrants."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best = (0.0, np.zeros_like(gradient))
    n, m = gradient.shape
    for i in range(n - 1):
        j = np.arange(m - 1)
        parts = []
        for s, low in ((g, 0.0), (w, 1.0)):
            a, b, c = s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j]
            parts.append(np.stack([a, b, c, s[-1, -1] - a - b - c]) + low)
        gain = (parts[0] ** 2 / parts[1]).sum(0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            a, b, c, d = parts[0][:, at] / parts[1][:, at]
            step = np.empty_like(gradient)
            step[: i + 1, : at + 1], step[: i + 1, at + 1:], step[i + 1:, : at + 1], step[i + 1:, at + 1:] = a, b, c, d
            best = (float(gain[at]), step)
    return best


@dataclass
class Additive:
    """Bin edges and tables per feature and per pair of features."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for column, (edges, held) in enumerate(zip(self.edges, self.tables)):
            total += held[np.searchsorted(edges, rows[:, column], "right")]
        binned = [np.searchsorted(edges, rows[:, c], "right") for c, edges in enumerate(self.pair_edges)]
        for (a, b), held in zip(self.pairs, self.pair_tables):
            total += held[binned[a], binned[b]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(rows: np.ndarray, labels: np.ndarray) -> Additive:
    share = np.clip(labels.mean(), 0.01, 0.99)
    model = Additive(float(np.log(share / (1 - share))), [_edges(c, BINS) for c in rows.T], [], [_edges(c, PAIR_BINS) for c in rows.T], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, rows.T)]
    total = np.full(len(rows), model.start)
    for _ in range(CYCLES):
        for bins, held in zip(binned, model.tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(bins, labels - p, len(held)), np.bincount(bins, p * (1 - p), len(held)))
            held += step
            total += step[bins]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, rows.T)]
    shapes = [len(e) + 1 for e in model.pair_edges]

    def cells(pair, values):
        a, b = pair
        return np.bincount(coarse[a] * shapes[b] + coarse[b], values, shapes[a] * shapes[b]).reshape(shapes[a], shapes[b])

    p = 1 / (1 + np.exp(-total))
    gains = {pair: _quadrants(cells(pair, labels - p), cells(pair, p * (1 - p)))[0] for pair in combinations(range(len(FEATURES)), 2)}
    model.pairs = sorted(sorted(gains, key=gains.get, reverse=True)[:PAIRS])
    model.pair_tables = [np.zeros((shapes[a], shapes[b])) for a, b in model.pairs]
    for _ in range(PAIR_CYCLES):
        for (a, b), held in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _quadrants(cells((a, b), labels - p), cells((a, b), p * (1 - p)))[1]
            held += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT


def train(measured: DataFrame, labels: DataFrame) -> Additive | None:
    """Model of at most `FIT_ROWS` labelled rows that are not held out."""
    quality = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = measured.where(~held_out()).join(quality, "doc_id")
    # Ordered, so the model does not depend on the order in which tasks end.
    sample = bounded_sample(known.select("doc_id", "features", "quality"), "doc_id", FIT_ROWS).toPandas().sort_values("doc_id")
    if not len(sample):
        return None
    return fit(np.array(sample["features"].tolist(), float), sample["quality"].to_numpy(float))


def with_scores(measured: DataFrame, model: Additive | None) -> DataFrame:
    held = measured.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        matrix = np.array(batch.column(1).flatten()).reshape(-1, len(FEATURES))
        scores = held.value.scores(matrix) if held.value else np.full(batch.num_rows, 0.5)
        return {"doc_id": batch.column(0), "score": pa.array(scores)}

    return map_arrow(measured.select("doc_id", "features"), rows, "doc_id long, score double")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    measured = materialise(with_features(docs), "features")
    scored = with_scores(measured, train(measured, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
