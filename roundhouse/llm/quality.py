"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import map_batches

BITS = 18
THRESHOLD = 0.3
TRAIN_ROWS = 16_000  # bound of the labelled sample the model is fitted on
SHARDS = 4
EPOCHS = 4


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


_CLASS = np.arange(256, dtype=np.uint64)  # punctuation stands for itself
for _lo, _hi, _kind in ((0x30, 0x3A, 0x30), (0x41, 0x5B, 0x41), (0x61, 0x7B, 0x61), (0x80, 0x100, 0x80)):
    _CLASS[_lo:_hi] = _kind


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature of every word n-gram, first feature of each text).

    Words and word pairs, each as written and as its form (kinds of the first
    and last character, length up to 3), which also speaks for unseen words.
    """
    words, first, starts, ends = T.word_hashes(buf, offsets)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    form = T.mix(_CLASS[buf[starts]] + (_CLASS[buf[ends - 1]] << np.uint64(8))
                 + (np.minimum(ends - starts, 3).astype(np.uint64) << np.uint64(16)))
    inner = np.flatnonzero(doc[:-1] == doc[1:])
    pairs, form_pairs = T.windows_hash(words, 2)[inner], T.windows_hash(form, 2)[inner]
    form_pairs[words[inner] == words[inner + 1]] = np.uint64(0x5EED << 48)  # the form of any repeated word
    every = np.concatenate([words, form, pairs, form_pairs])
    docs = np.concatenate([doc, doc, doc[inner], doc[inner]])
    order = np.argsort(docs, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(n)))])
    return (every[order] >> np.uint64(64 - bits)).astype(np.int64), start


def ftrl(rows: list[tuple[np.ndarray, float]], bits: int, epochs: int, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> np.ndarray:
    """Per-coordinate FTRL-proximal over (features, label); the last slot is the bias.

    A feature's value is its count over the root of the text's feature number.
    """
    z = np.zeros((1 << bits) + 1)
    n = np.zeros_like(z)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0,
                        -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    prepared = []
    for ids, y in rows:
        i, count = np.unique(ids, return_counts=True)
        prepared.append((np.append(i, 1 << bits), np.append(count / np.sqrt(max(len(ids), 1)), 1.0), y))
    for _ in range(epochs):
        for i, x, y in prepared:
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(len(z)))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, rows: int = TRAIN_ROWS,
          shards: int = SHARDS, epochs: int = EPOCHS, folds: int = 5) -> np.ndarray:
    """Weights fitted on at most ``rows`` labelled rows outside the held-out fold.

    The sample is the ``rows`` labels of smallest seeded hash. Each shard of it
    runs FTRL in a task of its own and the weights of the shards that have rows
    are averaged. Rows that repeat a labelled doc_id teach once, by their smallest
    text. With no usable label all weights are 0 (every score 0.5).
    """
    usable = (labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0))
              .select("doc_id", F.col("quality").cast("double").alias("y"),
                      F.xxhash64("doc_id", F.lit("quality")).alias("_h")))
    sample = usable.orderBy("_h", "doc_id", "y").limit(rows)  # at most `rows` small rows: safe to broadcast
    joined = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
              .groupBy("doc_id", "_h", "y").agg(F.min("text").alias("text"))  # at most `rows`, however often an id repeats
              .withColumn("shard", F.pmod(F.col("_h"), F.lit(shards)).cast("int")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow as pa
        pdf = pdf.assign(text=pdf["text"].fillna("")).sort_values(["_h", "doc_id", "y", "text"])
        data, ys = [], pdf["y"].to_numpy()
        for lo, hi, buf, offsets in T.slices(pa.array(pdf["text"], type=pa.large_string())):
            ids, start = features(buf, offsets, bits)
            data += [(ids[start[k]:start[k + 1]], ys[lo + k]) for k in range(hi - lo)]
        w = ftrl(data, bits, epochs)
        keep = np.append(np.flatnonzero(w), -1)  # and one row that counts the shard
        return pd.DataFrame({"feature": keep, "w": np.append(w[keep[:-1]], 1.0)})

    models = joined.groupBy("shard").applyInPandas(fit, "feature long, w double")
    weights = np.zeros((1 << bits) + 1)
    rows_ = models.groupBy("feature").agg(F.sum("w").alias("w")).toPandas()  # at most 2**bits + 2 rows
    total = dict(zip(rows_["feature"], rows_["w"])).pop(-1, 1.0)  # shards with rows
    rows_ = rows_[rows_["feature"] >= 0]
    weights[rows_["feature"].to_numpy(dtype=np.int64)] = rows_["w"].to_numpy(dtype=float) / total
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` plus score: sigmoid of the sparse dot product.

    A null or empty text has no feature, so its score is the bias's.
    """
    keep = keep if keep is not None else docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["score double"])

    def run(batch):
        w = shared.value
        out = np.empty(batch.num_rows)
        for lo, hi, buf, offsets in T.slices(batch.column("_text")):
            ids, start = features(buf, offsets, bits)
            total = np.concatenate([[0.0], np.cumsum(w[ids])])
            size = np.diff(start)
            logit = (total[start[1:]] - total[start[:-1]]) / np.sqrt(np.maximum(size, 1)) + w[-1]
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        return {**{c: batch.column(c) for c in keep}, "score": out}

    source = docs.select(*keep, F.col("text").alias("_text"))
    return map_batches(source, schema, run)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts score the bias; a null doc_id is never held out.
    Repeated rows are scored each; extra columns are ignored.
    """
    weights = train(docs, labels, **options)
    scored = score(docs.select("doc_id", "text"), weights, keep=["doc_id"], bits=options.get("bits", BITS))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
