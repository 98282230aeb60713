"""Quality rules: counts of every whole text, base limits, and an isolation forest over the counts' rates.

Fit: at most ``sample_rows`` labelled documents (by seeded hash of their ids,
so a rerun takes the same) give the forest its sample and the labels calibrate
one threshold for each band of word counts: among the cuts that reject at most
``max_clean_rejected`` of the good rows, the most lenient one within 2 % of the
best recall.  The forest is random splits over ``TREE_ROWS`` rows a tree; a
document's score is 2 ** (-mean path length / expected path length), so short
paths (anomalies) score high.

Apply: one map over the scan; the forest (a few thousand numbers) goes along
with the task.  Null text has no words.  Documents without words, or under 20,
fail the base limits.  Without labels of both kinds (an empty label table, say)
nothing but the base limits rejects.  Null ids keep their row; labels with a
null id or quality are not used; of repeated labels the higher quality counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.llm.rule_stats import NAMES, base_failed, rule_stats

SAMPLE_ROWS = 20_000
TREES = 200
TREE_ROWS = 256
#: Poor rows for a good one in the trees' sample.
POOR_SHARE = 0.03
#: Lower ends of the bands of word counts that have thresholds of their own.
BANDS = np.array([20, 60, 200])


def rates(stats: np.ndarray) -> np.ndarray:
    """Rule statistics made comparable across lengths: symbols a character, repeated lines and words a word, characters a word."""
    n, chars, symbols, lines, repeats = stats.astype(np.float64).T
    words = np.maximum(n, 1)
    return np.stack([np.minimum(symbols / np.maximum(chars, 1), 0.5), np.minimum(lines / words, 1), repeats / words, np.clip(chars / words, 2, 12) / 40], axis=1)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    more = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(more - 1) + 0.5772156649) - 2 * (more - 1) / more, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees side by side, as arrays over nodes; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    tree_rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[t][at]] < self.cut[t][at], self.left[t][at], self.right[t][at])
            total += self.path[t][at]
        return 2.0 ** (-total / len(self.feature) / max(float(expected_path(self.tree_rows)), 1e-9))


def fit_forest(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    tree_rows = min(tree_rows, len(x))
    deepest = max(1, int(np.ceil(np.log2(max(tree_rows, 2)))))
    grown = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int, nodes: list = nodes) -> int:
            me = len(nodes)
            nodes.append([0, np.inf, me, me, depth + float(expected_path(len(rows)))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_to = np.flatnonzero(high > low)
            if depth < deepest and len(open_to):
                k = int(rng.choice(open_to))
                cut = rng.uniform(low[k], high[k])
                side = rows[:, k] < cut
                if side.any() and not side.all():
                    nodes[me][:2] = [k, cut]
                    nodes[me][2] = grow(rows[side], depth + 1)
                    nodes[me][3] = grow(rows[~side], depth + 1)
            return me

        grow(x[rng.choice(len(x), tree_rows, replace=False)], 0)
        grown.append(np.array(nodes))
    size = max(map(len, grown))
    full = np.stack([np.vstack([g, np.tile([0, np.inf, 0, 0, 0], (size - len(g), 1))]) for g in grown])
    return Forest(full[..., 0].astype(np.int64), full[..., 1], full[..., 2].astype(np.int64), full[..., 3].astype(np.int64), full[..., 4], deepest, tree_rows)


@dataclass
class QualityModel:
    forest: Forest | None = None
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(BANDS), np.inf))

    def rejected(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anomaly scores, and which rows score above the threshold of their band."""
        if self.forest is None or not len(stats):
            return np.zeros(len(stats)), np.zeros(len(stats), dtype=bool)
        scores = self.forest.scores(rates(stats))
        return scores, scores > self.thresholds[band(stats[:, 0])]


def band(n_words: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(BANDS, n_words, side="right") - 1, 0)


def threshold(scores: np.ndarray, good: np.ndarray, max_clean_rejected: float) -> float:
    """Infinity unless both kinds are there and a cut separates some of them."""
    if good.all() or not good.any():
        return np.inf
    cuts = np.unique(scores)
    cuts = (cuts[:-1] + cuts[1:]) / 2
    if not len(cuts):
        return np.inf
    clean, poor = np.sort(scores[good]), np.sort(scores[~good])
    wrong = 1 - np.searchsorted(clean, cuts, side="right") / len(clean)
    recall = 1 - np.searchsorted(poor, cuts, side="right") / len(poor)
    allowed = wrong <= max_clean_rejected
    if not allowed.any() or recall[allowed].max() <= 0.05:
        return np.inf
    return float(cuts[allowed & (recall >= recall[allowed].max() - 0.02)].max())


def calibrated(stats: np.ndarray, good: np.ndarray, max_clean_rejected: float = 0.002, seed: int = 7) -> QualityModel:
    """A model from the statistics of labelled rows; base failures take no part."""
    use = np.array([not base_failed(n, r) for n, r in stats[:, [0, 4]]], dtype=bool) if len(stats) else np.zeros(0, dtype=bool)
    if not (use & good).any() or not (use & ~good).any():
        return QualityModel()
    # a cluster hides its own rows: poor rows, those of the base limits too, stay rare where trees grow
    poor = np.random.default_rng(seed).permutation(np.flatnonzero(~good))[: max(2, int(POOR_SHARE * (use & good).sum()))]
    forest = fit_forest(rates(np.concatenate([stats[use & good], stats[poor]])), seed=seed)
    stats, good = stats[use], good[use]
    x = rates(stats)
    scores, bands = forest.scores(x), band(stats[:, 0])
    overall = threshold(scores, good, max_clean_rejected)
    each = [threshold(scores[bands == b], good[bands == b], max_clean_rejected) if (good & (bands == b)).sum() >= 100 and (~good & (bands == b)).sum() >= 20 else overall for b in range(len(BANDS))]
    return QualityModel(forest, np.array(each))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_clean_rejected: float = 0.002, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Model from at most ``sample_rows`` labelled documents; only their counts come to the driver."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("good")).dropna().groupBy("id").agg(F.max("good").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([rule_stats(t.as_py()) for t in batch.column(1)], dtype=np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, stats.T)], ["good", *NAMES])

    # rows that repeat an id carry its label too: the bound holds for rows as well, and a hash picks the same ones again
    found = rows.mapInArrow(run, "good int, " + ", ".join(f"{n} long" for n in NAMES)).orderBy(F.xxhash64("good", *NAMES), "good", *NAMES).limit(2 * sample_rows).toPandas().sort_values(["good", *NAMES])
    return calibrated(found[list(NAMES)].to_numpy(dtype=np.int64), found["good"].to_numpy() > 0, max_clean_rejected, seed)


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, then the counts, ``base_failed``, ``score`` and ``kept``; a clashing input column is replaced."""
    added = [*((n, "long") for n in NAMES), ("base_failed", "boolean"), ("score", "double"), ("kept", "boolean")]
    own = [c for c in docs.columns if c not in dict(added) or c == text_col]
    at = own.index(text_col)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([rule_stats(t.as_py()) for t in batch.column(at)], dtype=np.int64).reshape(-1, len(NAMES))
            failed = (stats[:, 0] < 20) | (100 * stats[:, 4] > 30 * stats[:, 0])
            scores, odd = model.rejected(stats)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (*stats.T, failed, scores, ~failed & ~odd))], [*batch.schema.names, *(f"a{i}" for i in range(len(added)))])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema)), *(f"a{i} {kind}" for i, (_, kind) in enumerate(added))])
    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *[F.col(f"a{i}").alias(n) for i, (n, _) in enumerate(added) if n not in own])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """Counts and verdict of every document: id, the counts, ``base_failed``, ``score``, ``kept``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    return with_quality(docs.select(F.col(id_col), F.col(text_col)), model, text_col).drop(text_col)
