"""Helpers that several operators of this package use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other code point stays."""
    return F.translate(text, UPPER, UPPER.lower())


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where none
    is named (tests on one machine) a temporary one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_blocks(texts: pa.Array, size: int) -> Iterator[list[str]]:
    """The texts (null: empty) as lists of about `size` bytes each, one text at least, so that little is held at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(start, stop - start).fill_null("").to_pylist()
        start = stop


def code_points(texts: Sequence[str]) -> np.ndarray:
    """All code points of the texts, one after the other, as uint32."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` codes; shorter input gives none.

    Polynomial hashes of half the width are joined, so a window costs
    log2(width) steps; a final multiplication and shift spread the bits.
    """
    base = np.uint64(0x9E3779B97F4A7C15)

    def rolled(w: int) -> np.ndarray:
        if w == 1:
            return codes.astype(np.uint64) + np.uint64(1)
        half = rolled(w // 2)
        n = len(codes) - w + 1
        with np.errstate(over="ignore"):
            shift = np.uint64(pow(int(base), w // 2, 1 << 64))
            both = half[: len(codes) - 2 * (w // 2) + 1] + shift * half[w // 2 :]
            if w % 2:
                last = np.uint64(pow(int(base), w - 1, 1 << 64))
                both = both[:n] + last * (codes[w - 1 :].astype(np.uint64) + np.uint64(1))
        return both[:n]

    if len(codes) < width:
        return np.zeros(0, np.uint64)
    return mixed(rolled(width))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))
