"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.llm.shared import code_points, lower_ascii, table, window_hashes

#: Fixed values: (verdict, host and path prefix).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Rows of the labelled table that the regression is fitted on, at most.
SAMPLE = 4096


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own_host, own_path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


@dataclass(frozen=True)
class UrlModel:
    """Weights of hashed n-grams; a URL's score is the sigmoid of their mean times `gain` plus the bias."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5)
    gain: float = 8.0

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        if not len(hosts):
            return np.zeros(0)
        bucket, row = features(hosts, paths, self.sizes, len(self.weights))
        total = np.bincount(row, self.weights[bucket], minlength=len(hosts))
        number = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        return 1 / (1 + np.exp(-(self.gain * total / number + self.bias)))


def features(hosts: Sequence[str], paths: Sequence[str], sizes: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram. Host and path are marked apart by the signs around them."""
    marked = [f"<{h}>{p}\n" for h, p in zip(hosts, paths)]
    codes = code_points(marked)
    row = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    found, rows = [], []
    for n in sizes:
        h = window_hashes(codes, n)
        inside = row[: len(h)] == row[n - 1 :][: len(h)]
        found.append((h[inside] % np.uint64(buckets)).astype(np.int64))
        rows.append(row[: len(h)][inside])
    return np.concatenate(found), np.concatenate(rows)


def fit(hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[bool], buckets: int = 1 << 14, steps: int = 200) -> UrlModel:
    """Batch gradient descent (Adam) on the mean n-gram weights, classes weighted evenly.

    Without rows of both classes the model knows nothing of n-grams and only
    keeps the class that it has seen (allow if none).
    """
    y = np.asarray(blocked, float)
    model = UrlModel(np.zeros(buckets), 0.0)
    if not len(y) or y.min() == y.max():
        return UrlModel(model.weights, 4.0 if len(y) and y[0] else -4.0)
    bucket, row = features(hosts, paths, model.sizes, buckets)
    share = model.gain / np.bincount(row, minlength=len(y))[row]
    even = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, first, second = np.zeros(buckets + 1), np.zeros(buckets + 1), np.zeros(buckets + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[bucket] * share, minlength=len(y)) + w[-1])))
        error = (p - y) * even
        g = np.append(np.bincount(bucket, error[row] * share, minlength=buckets), error.sum())
        g[:-1] += 1e-6 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return UrlModel(w[:-1].copy(), float(w[-1]))


def fit_table(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Fit on a small table (host, path, verdict): its `sample` rows with the lowest hashes, if it has more."""
    rows = labelled.select("host", "path", "verdict").orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample).toPandas()
    return fit(rows["host"].tolist(), rows["path"].tolist(), (rows["verdict"] == "block").tolist())


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (chance of block by the regression) for each row of `pages`.

    labelled: a small table (host, path, verdict) to learn from; by default the
    URLs of `pages` that a rule decides. Rules outrank the regression. Null and
    malformed URLs have empty host and path and go by the regression, too;
    repeated rows stay; further columns are ignored.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.filter("fit is not null").select("host", "path", F.col("fit.verdict").alias("verdict"))
    model = fit_table(labelled)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(model.scores(host.tolist(), path.tolist()))

    return ruled.withColumn("score", score("host", "path")).select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLE: dict[str, str] = {}
