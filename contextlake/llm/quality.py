"""Quality classifier: naive Bayes support vectors on character n-gram indicators.

Log-count ratios cover all labelled rows that may be learned from. Indicators scaled by them are
the input of a linear hinge-loss model, fitted by dual coordinate descent on a bounded sample; a
sigmoid fitted on a part of the sample turns margins into probabilities at the labels' own rates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import ngrams, textkit

def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, width: int, cost: float = 1.0, epochs: int = 50, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss, by dual coordinate descent in the box 0 <= a <= cost. The last weight is the bias."""
    w, a = np.zeros(width + 1), np.zeros(len(rows))
    order = np.random.default_rng(seed)
    q = np.array([x @ x + 1 for _, x in rows])
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slots, x = rows[i]
            g = signs[i] * (w[slots] @ x + w[width]) - 1
            step = min(max(a[i] - g / q[i], 0.0), cost) - a[i]
            if step:
                a[i] += step
                w[slots] += step * signs[i] * x
                w[width] += step * signs[i]
                largest = max(largest, abs(step) * q[i])
        if largest < 1e-3:
            break
    return w


def fit_sigmoid(margins: np.ndarray, ones: np.ndarray, weights: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton steps on the weighted log loss, with smoothed targets."""
    up, down = weights[ones].sum(), weights[~ones].sum()
    target = np.where(ones, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)])
    t = np.array([1.0, float(np.log((up + 1) / (down + 1)))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(t @ x, -30, 30)))
        g = x @ (weights * (p - target)) + 1e-3 * t
        h = (x * (weights * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        t = t - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return float(t[0]), float(t[1])


def score_quality(docs: DataFrame, labels: DataFrame, sample_per_class: int = 2000, smoothing: float = 1.0, features: ngrams.Features = ngrams.Features(letters_only=False)) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of every row of docs (doc_id, text); labels gives doc_id and label (0 or 1).

    Null text is empty; an empty text gets the score of its (blank) n-grams. If labels has documents of one class only or
    none, every score is that class's, or 0.5. The sample has about sample_per_class rows of each class. Rows are judged
    one by one: repeated rows agree. Rows with a null or another label are not learned from; a document whose labels
    contradict each other neither, and equal labels of one document count once. Other columns are ignored; no rows: no rows.
    """
    spark = docs.sparkSession
    marked = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other AND doc_id IS NOT NULL").select("doc_id", "label")
    known = dict(marked.groupBy("label").count().collect())
    # labels grow with the documents, so neither side is broadcast at any size; this is the one join of the texts
    learn = docs.select("doc_id", "text").hint("merge").join(marked, "doc_id")
    share = F.when(F.col("label") == 1, min(1.0, sample_per_class / max(1, known.get(1, 0)))).otherwise(min(1.0, sample_per_class / max(1, known.get(0, 0))))
    width = 1 << features.bits
    df, n, sample = ngrams.gather(learn.select("doc_id", F.col("label").alias("g"), "label", "text"), features, 2, share, 4 * sample_per_class + 1000)
    if n.min() == 0:
        constant = 0.5 if n.max() == 0 else float(n[1] > 0)
        return docs.select("doc_id", F.lit(constant).alias("score"))
    p = (df + smoothing) / (df + smoothing).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])

    def scaled(slots: np.ndarray) -> np.ndarray:
        x = ratio[slots]
        return x / max(np.sqrt(x @ x), 1e-12)

    rows = [(slots, scaled(slots)) for _, slots, _ in sample]
    ones = np.array([label == 1 for label, _, _ in sample], dtype=bool)
    held = np.arange(len(rows)) % 4 == 0
    fit = [i for i in range(len(rows)) if not held[i] or len(rows) < 50]
    w = fit_hinge([rows[i] for i in fit], np.where(ones[fit], 1.0, -1.0), width)
    kept = [i for i in range(len(rows)) if held[i]] or fit
    margins = np.array([w[s] @ x + w[-1] for s, x in (rows[i] for i in kept)])
    share = {c: n[int(c)] / max(1, (ones == c).sum()) for c in (True, False)}
    rate = np.array([share[bool(ones[i])] for i in kept])
    a, b = fit_sigmoid(margins, ones[kept], rate * len(kept) / rate.sum())
    shared = spark.sparkContext.broadcast((ratio * w[:-1], ratio * ratio, w[-1], a, b))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, square, bias, a, b = shared.value
        for batch in batches:
            margin = np.zeros(batch.num_rows)
            for lo, hi, starts, slots, _ in features.slices(batch.column(1)):
                margin[lo:hi] = np.add.reduceat(weight[slots], starts) / np.maximum(np.sqrt(np.add.reduceat(square[slots], starts)), 1e-12) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))], names=["doc_id", "score"])
        textkit.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
