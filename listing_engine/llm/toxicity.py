"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, each hashed to a row of an
embedding table; a text is the mean over its distinct n-grams. Table and softmax are
trained together. Because both are linear, a row's embedding times the softmax
weights is one number, so scoring adds up numbers. A misspelt word shares most
n-grams, hence most of its score, with the word that was learnt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.llm.shared import code_points, table, text_blocks, window_hashes

#: Labelled rows that the classifier is fitted on, at most: so many toxic ones, and twice as many others.
SAMPLE = 1200
SIZES = (3, 5)
#: Features without a bearing that each text has besides its own, so that a few n-grams decide less.
NEUTRAL = 20


def _letters(codes: np.ndarray) -> np.ndarray:
    """Letters and digits as lower case, everything else as the blank (32)."""
    small = np.where((codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7), codes + 32, codes)
    word = (small >= 97) & (small <= 122) | (small >= 48) & (small <= 57) | (small >= 0xC0)
    return np.where(word, small, np.uint32(32)).astype(np.uint32)


def bags(texts: Sequence[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the text) of each distinct feature, sorted by text: the
    n-grams of each word with a blank on both sides; none crosses a blank inside.
    Lines that repeat within a text count once.
    """
    parts = [_letters(code_points([f" {t} "])) for t in texts]
    lengths = np.array([len(p) for p in parts])
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    text_of = np.repeat(np.arange(len(parts)), lengths)
    blank = codes == 32
    found, rows = [], []
    blanks = np.concatenate(([0], np.cumsum(blank)))
    for n in SIZES:
        h = window_hashes(codes, n)
        inner = blanks[n - 1 : n - 1 + len(h)] - blanks[1 : 1 + len(h)]  # blanks apart from the first and last sign
        own = (inner == 0) & (text_of[: len(h)] == text_of[n - 1 : n - 1 + len(h)])
        found.append(h[own])
        rows.append(text_of[: len(h)][own])
    bucket, row = (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(rows)
    pair = np.sort(row * buckets + bucket)
    pair = pair[np.diff(pair, prepend=-1) != 0]
    return pair % buckets, pair // buckets


@dataclass(frozen=True)
class ToxicityModel:
    """weight: each bucket's embedding times the difference of the softmax weights; bias: the difference of the biases."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Chance of label 1; texts without a word get that of the bias alone."""
        if not len(texts):
            return np.zeros(0)
        bucket, row = bags(texts, len(self.weight))
        total = np.bincount(row, self.weight[bucket], minlength=len(texts))
        number = np.bincount(row, minlength=len(texts)) + NEUTRAL
        return 1 / (1 + np.exp(-np.clip(total / number + self.bias, -60, 60)))


def fit(texts: Sequence[str], toxic: Sequence[int], buckets: int = 1 << 16, width: int = 2, steps: int = 120, prior: float | None = None) -> ToxicityModel:
    """Train embeddings and softmax together on whole texts (full batches, momentum), classes weighted evenly.

    prior: share of toxic texts where the model is used (default: as given); it
    only moves the bias, so that texts without features count as harmless.
    Without rows of both classes the score is 0.02 (or 0.98, if all are toxic).
    """
    y = np.asarray(toxic, int)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(buckets), 4.0 if len(y) and y[0] else -4.0)
    buckets_of, texts_of = [], []
    for start in range(0, len(y), 128):
        bucket, row = bags(texts[start : start + 128], buckets)
        buckets_of.append(bucket.astype(np.int32))
        texts_of.append((row + start).astype(np.int32))
    bucket, text = np.concatenate(buckets_of), np.concatenate(texts_of)
    share = (1 / (np.bincount(text, minlength=len(y)) + NEUTRAL))[text].astype(np.float32)
    used, column = np.unique(bucket, return_inverse=True)
    column = column.astype(np.int32)
    by_bucket = np.argsort(column, kind="stable").astype(np.int32)
    text_starts, bucket_starts = np.flatnonzero(np.diff(text, prepend=-1)), np.flatnonzero(np.diff(column[by_bucket], prepend=-1))
    text_of_bucket, share_of_bucket = text[by_bucket], share[by_bucket]
    rng = np.random.default_rng(1)
    params = [np.zeros((len(used), width), np.float32), rng.choice([-1.0, 1.0], width).astype(np.float32)[:, None] * np.array([-0.5, 0.5], np.float32), np.zeros(2, np.float32)]
    params[0] += rng.normal(0, 1e-3, params[0].shape).astype(np.float32)
    speed = [np.zeros_like(p) for p in params]
    even = (np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))).astype(np.float32)
    filled = np.unique(text)
    for step in range(steps):
        mean = np.zeros((len(y), width), np.float32)
        mean[filled] = _sums(params[0], column, share, text_starts)
        logits = mean @ params[1] + params[2]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= even[:, None]
        grads = [_sums(p @ params[1].T, text_of_bucket, share_of_bucket, bucket_starts), mean.T @ p, p.sum(axis=0)]
        for k, (g, most) in enumerate(zip(grads, (4.0, 0.05, 0.1))):
            # one scale for a whole table: n-grams without a bearing on the label hardly move
            speed[k] = 0.8 * speed[k] + 0.2 * g / (np.abs(g).max() + 1e-12)
            params[k] -= most * (1 - step / steps) * speed[k]
    weight = np.zeros(buckets)
    weight[used] = params[0] @ (params[1][:, 1] - params[1][:, 0])
    prior = min(max(y.mean() if prior is None else prior, 1e-3), 0.999)
    return ToxicityModel(weight, float(params[2][1] - params[2][0] + np.log(prior / (1 - prior))))


def _sums(values: np.ndarray, row: np.ndarray, share: np.ndarray, starts: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Weighted sums of `values[row]` over the runs that begin at `starts`, with bounded memory."""
    out = []
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        end = starts[j] if j < len(starts) else len(row)
        cut = slice(starts[i], end)
        out.append(np.add.reduceat(values[row[cut]] * share[cut, None], starts[i:j] - starts[i], axis=0))
        i = j
    return np.concatenate(out)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_tables(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on labelled documents that aren't held out: at most `sample` toxic
    and 2 * `sample` other rows, those with the lowest hashes of doc_id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    low = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.filter("toxic = 0").orderBy(*low).limit(2 * sample).union(known.filter("toxic = 1").orderBy(*low).limit(sample))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.toPandas().sort_values(["doc_id", "text"])
    return fit(rows["text"].tolist(), rows["toxic"].tolist(), prior=prior)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score (0 to 1) of each whole text; null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(block) for block in text_blocks(texts, 1 << 19))]))

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`docs` with `toxicity_score` (0 to 1); at 0.5 or more a document counts as toxic.

    Learns from `labels` (doc_id, toxic) only. Null labels and ids are left out
    of the fit; with no usable label every score is low (see fit()). Repeated
    rows stay, an empty table gives no row, a column of that name is replaced.
    """
    return docs.withColumn("toxicity_score", score_column(fit_tables(docs, labels, sample), F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
