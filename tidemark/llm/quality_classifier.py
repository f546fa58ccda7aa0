"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the text is; trees are grown on the driver over binned statistics of
a bounded labelled sample, flattened into arrays, and walked for many rows at once by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import SAMPLE_ROWS, held_out, labelled_sample

FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
STATISTICS = (
    "chars", "words", "mean_word", "distinct_words", "distinct_pairs", "echoes", "lines", "repeated_lines", "words_a_line",
    "letters", "upper", "digits", "symbols", "bars", "stops", "exclaims", "other_punctuation", "long_bytes", "upper_words", "marked_words",
)
_SYMBOLS, _BARS, _STOPS, _EXCLAIMS, _OTHER = b"#*$%&<>=+~^@_\\", b"|", b".,;:?", b"!", b"\"'()[]{}/-"


def statistics(text: str | None) -> list[float]:
    """The numbers the trees look at; ratios are of letters, words or lines. An empty text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda chars: float(count[list(chars)].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = float(count[65:91].sum())
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, len(set(zip(words, words[1:]))) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
        (upper + count[97:123].sum()) / size, upper / size, count[48:58].sum() / size, of(_SYMBOLS) / n, of(_BARS) / n, of(_STOPS) / n,
        of(_EXCLAIMS) / n, of(_OTHER) / n, count[128:].sum() / size, sum(map(bytes.isupper, words)) / n,
        sum(w[-1] in _SYMBOLS for w in words) / n,
    ]


@dataclass
class Trees:
    """Trees as arrays: feature (-1 at a leaf), bin threshold, right child (the left one follows its parent) and leaf value."""

    edges: list[np.ndarray]
    feature: np.ndarray
    threshold: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        binned = bins(rows, self.edges)
        at = np.tile(self.roots, (len(rows), 1))
        each = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            step = np.where(binned[each, np.maximum(f, 0)] <= self.threshold[at], at + 1, self.right[at])
            at = np.where(f < 0, at, step)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def bins(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, rows[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.int16) if len(rows) else np.zeros((0, len(edges)), np.int16)


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosting for the logistic loss. One label only, or no row, gives no tree and the smoothed share."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(rows) else np.zeros(0) for k in range(rows.shape[1])]
    out = {"feature": [], "threshold": [], "right": [], "value": []}
    roots: list[int] = []
    if 0 < labels.sum() < len(labels):
        binned, margin = bins(rows, edges), np.full(len(labels), base)
        offsets = np.arange(rows.shape[1]) * n_bins
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = p - labels, p * (1 - p)

            def split(index: np.ndarray, level: int) -> None:
                here = len(out["feature"])
                g, h = gradient[index].sum(), hessian[index].sum()
                for name, v in (("feature", -1), ("threshold", 0), ("right", -1), ("value", -rate * g / (h + ridge))):
                    out[name].append(v)
                if level < depth and len(index) >= 2:
                    cell = (binned[index] + offsets).ravel()
                    width = binned.shape[1] * n_bins
                    gs = np.bincount(cell, np.repeat(gradient[index], binned.shape[1]), width).reshape(-1, n_bins).cumsum(axis=1)
                    hs = np.bincount(cell, np.repeat(hessian[index], binned.shape[1]), width).reshape(-1, n_bins).cumsum(axis=1)
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    gain[(hs < least) | (h - hs < least)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        f, t = divmod(best, n_bins)
                        low = binned[index, f] <= t
                        out["feature"][here], out["threshold"][here], out["value"][here] = f, t, 0.0
                        split(index[low], level + 1)
                        out["right"][here] = len(out["feature"])
                        split(index[~low], level + 1)
                        return
                margin[index] += out["value"][here]

            roots.append(len(out["feature"]))
            split(np.arange(len(labels)), 0)
    kinds = {"feature": np.int32, "threshold": np.int16, "right": np.int32, "value": np.float64}
    arrays = {k: np.array(v, kinds[k]) for k, v in out.items()}
    return Trees(edges=edges, roots=np.array(roots, np.int32), base=base, depth=depth, **arrays)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `rows` labelled documents: what reaches the driver is their statistics, 160 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    table = labelled_sample(docs, labels, "quality", FOLDS, FOLD, rows).mapInArrow(run, "x array<double>, label int").toArrow()
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    y = table.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # one order for one set of rows, so that reruns agree
    return grow(x[order], y[order])


def classify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row. Null counts as empty; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x))], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify for all documents, by trees of the labels outside the fold; null and empty texts score as zeros, repeats alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = classify(docs, trees)
    return scores.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
