"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all rows that may be learned from; weights are fitted on a bounded sample
of them by FTRL-proximal steps with L1 and L2 penalties, which leave most weights at zero; a
temperature fitted on a part of the sample that the weights have not seen calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contextlake.llm import ngrams, textkit

def _vector(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[slots]
    return x / max(np.sqrt(x @ x), 1e-12)


def judge(idf: np.ndarray, weights: np.ndarray, starts: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest class, its probability) of each row of a slice."""
    x = (1 + np.log(counts)) * idf[slots]
    norm = np.maximum(np.sqrt(np.add.reduceat(x * x, starts)), 1e-12)
    scores = np.stack([np.add.reduceat(x * w[slots], starts) / norm for w in weights])
    p = np.exp(scores - scores.max(axis=0))
    return p.argmax(axis=0), p.max(axis=0) / p.sum(axis=0)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, width: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> np.ndarray:
    """Sparse weights (classes, width) by follow-the-regularised-leader over the rows, in their order."""
    z, n = np.zeros((classes, width)), np.zeros((classes, width))

    def weights(at) -> np.ndarray:
        za, na = z[:, at], n[:, at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for slots, x, label in rows:
            w = weights(slots)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * x
            old = n[:, slots]
            new = old + g * g
            z[:, slots] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[:, slots] = new
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, of a fixed grid, with the least mean log loss."""
    grid = np.geomspace(0.02, 10, 60)

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    return float(min(grid, key=loss)) if len(labels) else 1.0


def identify(docs: DataFrame, learn_from: DataFrame, sample_per_language: int = 800, sample_rows: int = 64000, bits: int = 16, model_cells: int = 1 << 26, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carry columns, lang_pred, score of every row of docs; learn_from gives doc_id, text and lang.

    lang_pred is ``und`` with score 0 where text is null or has no letter, or where nothing could be
    learned. Rows of learn_from without text or lang are not learned from. The sample has about
    sample_per_language rows of each language and about sample_rows in all; every language is learned, and of more than
    model_cells / 2**bits languages the n-grams share fewer slots. Rows are judged one by one: repeated rows
    agree, whatever their ids, null ones too. Other columns are ignored; no rows: no rows.
    """
    spark = docs.sparkSession
    learn = learn_from.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    # a row for each language
    counts = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    bits = max(8, min(bits, (model_cells // max(1, len(names))).bit_length() - 1))
    features = ngrams.Features(bits=bits, letters_only=True)
    model = None
    if names:
        each = min(sample_per_language, max(1, sample_rows // len(names)))
        table = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, F.struct(F.lit(i).alias("label"), F.lit(min(1.0, each / counts[k])).alias("share")))])
        coded = learn.select("doc_id", F.element_at(table, F.col("lang")).alias("c"), "text").select("doc_id", F.lit(0).alias("g"), "c.label", "c.share", "text")
        df, n, sample = ngrams.gather(coded, features, 1, F.col("share"), 2 * each * len(names) + 1000)
        idf = np.log((1 + n.sum()) / (1 + df.sum(axis=0))) + 1
        rows = [(slots, _vector(slots, c, idf), label) for label, slots, c in sample]
        fit = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 50]
        weights = fit_ftrl(fit, len(names), 1 << bits)
        kept = [r for i, r in enumerate(rows) if not i % 5]
        heat = fit_temperature(np.array([weights[:, s] @ x for s, x, _ in kept]).reshape(len(kept), len(names)), np.array([y for _, _, y in kept], dtype=int))
        model = (names, idf.astype(np.float32), (weights / heat).astype(np.float32))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = np.asarray(pc.match_substring_regex(batch.column(0), r"\pL").fill_null(False).to_numpy(zero_copy_only=False)).astype(bool)
            best, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if shared.value is None:
                lettered[:] = False
            else:
                for lo, hi, starts, slots, c in features.slices(batch.column(0)):
                    best[lo:hi], top[lo:hi] = judge(*shared.value[1:], starts, slots, c)
            known = pa.array(shared.value[0] if shared.value else [], pa.string())
            langs = pc.fill_null(known.take(pa.array(best, mask=~lettered)), "und")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], langs, pa.array(np.where(lettered, top, 0.0))], names=[*batch.schema.names[1:], "lang_pred", "score"])
        textkit.give_back()

    passed = docs.select(F.col("text").alias("judged_text"), "doc_id", *carry)
    schema = StructType(passed.schema.fields[1:] + StructType.fromDDL("lang_pred string, score double").fields)
    return passed.mapInArrow(run, schema)
