"""Quality rules: counts per text, and an isolation forest over them.

The base rule is fixed. The verdict on the other documents comes from an
isolation forest over the plain statistics: random splits of sampled rows, where
a document that is separated after few splits is anomalous. A split takes a
statistic the more often, the further apart labels set it in the sample; with
equal chances, rare lengths and repeats would hide what labels call bad. Trees
grow on rows of which at most one in `ORDINARY` is bad, so anomalies stay rare.
The threshold on the score is calibrated on labelled rows that trees never saw.

A null text has no words, and like every text of under 50 words it fails the base
rule. Rows are judged one by one, so ties and repeated rows get equal verdicts;
an empty table gives an empty result; extra columns are ignored. Very long texts
are counted whole. Without any labelled rows there is no forest and only the base
rule decides; without bad ones among those that calibrate nothing else is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bounded_sample, map_arrow, query, small_batches, table, text_of
from tidegauge.session import materialise

MIN_WORDS = 50
#: Documented bound: labelled rows the forest is fitted on.
FIT_ROWS = 20_000
TREES, SAMPLE, DEPTH = 200, 256, 10
#: Good rows to a bad one among those that trees are grown on, if there are as many.
ORDINARY = 50
#: Labelled rows are dealt by a hash into so many parts; these are for fitting and calibrating.
PARTS, FIT_PARTS, CALIBRATE_PARTS = 4, (0, 1), (2, 3)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest looks at: logarithm of the words, mean word length, and shares.
SHARES = ["log_words", "word_length", "symbols", "capitals", "exclamations", "stutter", "dup_lines", "repeats"]
SCHEMA = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in SHARES]])


def repeated_words(words: list, size: int = 3) -> int:
    """Words covered by windows of ``size`` words that occur twice or more, first ones included."""
    if len(words) <= size:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    code = ids[: len(ids) - size + 1].copy()
    for k in range(1, size):  # dense codes again after each step, so nothing overflows
        code = np.unique(code * len(known) + ids[k: len(ids) - size + 1 + k], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(code)[code] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str) -> tuple:
    """The counts of the base rule and the shares the forest looks at."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return (0, chars, symbols, dup_lines, repeats, *[0.0] * len(SHARES))
    capitals = sum(len(w) > 2 and w.isupper() for w in text.split()) / n
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    shares = (math.log(n), chars / n, symbols / n, capitals, text.count("!") / n, stutter, dup_lines / max(1, len(lines)), repeats / n)
    return (n, chars, symbols, dup_lines, repeats, *shares)


def with_statistics(docs: DataFrame) -> DataFrame:
    def rows(batch):
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        columns = zip(*found) if found else [[] for _ in COUNTS + SHARES]
        return {"doc_id": batch.column(0), **{c: list(v) for c, v in zip(COUNTS + SHARES, columns)}}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), rows, SCHEMA)


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: split column, split value, children, and path length of leaves."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    sample: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in 0..1 per row; higher is easier to isolate."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for column, value, left, path in zip(self.column, self.value, self.left, self.path):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                child = left[node]
                node = np.where(child > 0, child + (rows[every, column[node]] > value[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.column) / max(float(average_path(self.sample)), 1.0))


def telling(rows: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Chance of each column to be split: the square of the largest distance between
    the distributions of good and bad rows. Columns that labels do not tell apart
    keep a little; all are equal if there are rows of one label only."""
    if bad.all() or not bad.any():
        return np.ones(rows.shape[1])
    chances = []
    for column in rows.T:
        values = np.unique(column)
        shares = [np.searchsorted(np.sort(column[own]), values, "right") / own.sum() for own in (bad, ~bad)]
        chances.append(max(0.01, float(np.abs(shares[0] - shares[1]).max()) ** 2))
    return np.array(chances)


def fit_forest(rows: np.ndarray, chances: np.ndarray | None = None, seed: int = 7) -> Forest:
    chances = np.ones(rows.shape[1]) if chances is None else chances
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, len(rows))
    most = 2 ** (DEPTH + 1)
    columns, values, lefts, paths = [], [], [], []
    for _ in range(TREES):
        column, value, left, path = np.zeros(most, np.int64), np.zeros(most), np.zeros(most, np.int64), np.zeros(most)
        todo, made = [(0, rng.choice(len(rows), size, replace=False), 0)], 1
        while todo:
            node, own, depth = todo.pop()
            part = rows[own]
            low, high = part.min(0), part.max(0)
            spread = np.flatnonzero(high > low)
            if depth == DEPTH or len(own) < 2 or not len(spread):
                path[node] = depth + float(average_path(len(own)))
                continue
            c = rng.choice(spread, p=chances[spread] / chances[spread].sum())
            # The range is widened a little, so a row beyond every sampled one is told apart too.
            edge = 0.1 * (high[c] - low[c])
            cut = rng.uniform(low[c] - edge, high[c] + edge)
            column[node], value[node], left[node] = c, cut, made
            right = part[:, c] > cut
            for side in (own[~right], own[right]):
                if len(side):
                    todo.append((made, side, depth + 1))
                else:
                    path[made] = depth + 1
                made += 1
        columns.append(column), values.append(value), lefts.append(left), paths.append(path)
    return Forest(np.array(columns), np.array(values), np.array(lefts), np.array(paths), size)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_labels(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that pass the base rule, with ``quality`` and the ``part`` they are dealt into."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(PARTS))
    return measured.where(~base_failed()).join(known, "doc_id").withColumn("part", part)


def fit_rules(measured: DataFrame, labels: DataFrame, calibrate: Sequence[int] = CALIBRATE_PARTS):
    """Forest from a bounded sample of the rows dealt to it, threshold from all rows of ``calibrate``."""
    labelled = with_labels(measured, labels)
    sample = bounded_sample(labelled.where(F.col("part").isin(*FIT_PARTS)).select("doc_id", *SHARES, "quality"), "doc_id", FIT_ROWS)
    # Up to FIT_ROWS rows of a few numbers; a forest of TREES small trees comes of them.
    sampled = sample.toPandas().sort_values(["doc_id", *SHARES])
    if not len(sampled):
        return None, 2.0
    rows, bad = sampled[SHARES].to_numpy(float), (sampled["quality"] == 0).to_numpy()
    most = max(1, (~bad).sum() // ORDINARY) if not bad.all() else len(bad)
    few = np.flatnonzero(bad)[:: -(-max(1, bad.sum()) // most)]
    forest = fit_forest(rows[np.sort(np.concatenate([np.flatnonzero(~bad), few]))], telling(rows, bad))
    scored = with_scores(labelled.where(F.col("part").isin(*calibrate)).select("doc_id", *SHARES, "quality"), forest)
    return forest, calibrated(scored)


def held_out_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label the rows and those kept, in a part that neither fits nor calibrates."""
    *calibrate, unseen = CALIBRATE_PARTS
    measured = materialise(with_statistics(docs), "statistics")
    forest, threshold = fit_rules(measured, labels, calibrate)
    rows = with_labels(measured, labels).where(F.col("part") == unseen)
    scored = with_scores(rows, forest) if forest else rows.withColumn("score", F.lit(0.0))
    return scored.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < threshold).alias("n_kept"))


def calibrated(scored: DataFrame) -> float:
    """Score above which rejecting gains most: share of bad rows less share of good rows.

    Labels are counted per thousandth of the score, in all rows of ``scored``.
    """
    counts = scored.groupBy(F.floor(F.col("score") * 1000).cast("int").alias("cell")).agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad")
    )
    good, bad = np.zeros(1002), np.zeros(1002)
    for row in counts.collect():  # at most a thousand rows
        good[row["cell"]], bad[row["cell"]] = row["good"], row["bad"]
    if not bad.sum():
        return 2.0
    kept_good, kept_bad = np.cumsum(good) / max(1.0, good.sum()), np.cumsum(bad) / bad.sum()
    gain = np.round(kept_good - kept_bad, 9)
    best = np.flatnonzero(gain == gain.max())
    # Of equally good thresholds the middle of the mildest run, as far from good rows as from bad ones.
    run = best[np.flatnonzero(np.diff(best, prepend=-2) > 1)[-1] <= np.arange(len(best))]
    return float((run[len(run) // 2] + 1) / 1000)


def with_scores(measured: DataFrame, forest: Forest) -> DataFrame:
    """``measured`` with the forest's anomaly score."""
    held = measured.sparkSession.sparkContext.broadcast(forest)
    names = measured.columns

    def rows(batch):
        matrix = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in SHARES], 1)
        return {**{n: batch.column(i) for i, n in enumerate(names)}, "score": held.value.scores(matrix)}

    return map_arrow(measured, rows, ", ".join(f"{n} {t}" for n, t in [*measured.dtypes, ("score", "double")]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, ``base_failed``, the score and ``kept``."""
    measured = materialise(with_statistics(docs), "statistics")
    forest, threshold = fit_rules(measured, labels)
    scored = with_scores(measured, forest) if forest else measured.withColumn("score", F.lit(0.0))
    return scored.select(
        "doc_id", *COUNTS, "score", base_failed().alias("base_failed"), (~base_failed() & (F.col("score") < threshold)).alias("kept")
    )


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    Statistics are taken once to fit and calibrate, and again while the rows are
    filtered where they are; texts are not shuffled.
    """
    forest, threshold = fit_rules(materialise(with_statistics(docs), "statistics"), labels)
    held = docs.sparkSession.sparkContext.broadcast(forest)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = np.array([statistics(t or "") for t in batch.column(place).to_pylist()], float).reshape(-1, len(COUNTS) + len(SHARES))
            good = (found[:, 0] >= MIN_WORDS) & (100 * found[:, 4] <= 50 * found[:, 0])
            if held.value is not None and good.any():
                good[good] = held.value.scores(found[good, len(COUNTS):]) < threshold
            yield batch.filter(pa.array(good))

    return small_batches(docs).mapInArrow(run, docs.schema)


@query("op6_quality_rules")
def op6(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")
