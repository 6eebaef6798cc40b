"""Texts as sets of word shingles, all in whole-array steps: 64-bit hashes, names, MinHash values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from listing_engine.llm.shared import UPPER, mixed, text_blocks

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
#: Bytes of text that are hashed at a time (one text at least).
BLOCK = 1 << 18


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the number of its text.

    Words are runs of bytes between \\x20 and \\x09-\\x0D, A-Z lower-cased. Sums
    of byte * base**place over the joined texts give every word's polynomial as
    a difference, freed of its place by the inverse base.
    """
    data = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    codes = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    space = _SPACE[codes]
    turn = np.diff(space.astype(np.int8))
    start, end = np.flatnonzero(turn == -1) + 1, np.flatnonzero(turn == 1) + 1
    powers = np.cumprod(np.full(len(codes), _BASE, np.uint64))
    back = np.cumprod(np.full(len(codes), pow(_BASE, -1, 1 << 64), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers)))
    hashes = mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(np.cumsum([len(d) + 1 for d in data]), start, side="left")


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; fewer words: one shingle of all; no word: none."""
    hashes, owner = word_hashes(texts)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()

    def joined(h: np.ndarray, n: int) -> np.ndarray:
        runs = h[: len(h) - n + 1]
        for k in range(1, n):
            runs = mixed(runs * np.uint64(_STEP) ^ mixed(h[k : len(h) - n + 1 + k] + np.uint64(1)))
        return runs

    runs = joined(hashes, words) if len(hashes) >= words else hashes[:0]
    sets = []
    for a, b in zip(cut[:-1], cut[1:]):
        few = 0 < b - a < words
        sets.append(mixed(joined(hashes[a:b], b - a) + np.uint64(b - a)) if few else np.unique(runs[a : max(a, b - words + 1)]))
    return sets


def set_name(members: np.ndarray) -> int:
    """A long that names a set."""
    return int(np.array(xxh64_intdigest(members.tobytes(), 1), np.uint64).view(np.int64))


def text_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), of about BLOCK bytes, so that little is held at a time."""
    for batch in batches:
        at = 0
        for texts in text_blocks(batch.column("text"), BLOCK):
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


def members_of(docs: DataFrame, words: int) -> DataFrame:
    """name, members (sorted hashes) of the set of shingles of each row's text."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_parts(batches):
            found = shingle_sets(texts, words)
            columns = [pa.array([set_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "members"])

    return docs.select("text").mapInArrow(members, "name long, members binary")


def minhashes(sets: list[np.ndarray], count: int) -> Iterator[np.ndarray]:
    """`count` times the least hashed member of each set (32 bits); no set may be empty."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    factors = np.random.default_rng(12).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for factor in factors:
        yield np.minimum.reduceat((flat * factor) >> np.uint64(32), at)


def signatures(sets: list[np.ndarray], bands: int, rows: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets x bands keys, each of `rows` MinHash values; sets x `values` bytes of further ones)."""
    keys = np.empty((len(sets), bands), np.uint64)
    rest = np.empty((len(sets), values), np.uint8)
    for i, least in enumerate(minhashes(sets, bands * rows + values)):
        if i < bands * rows:
            before = keys[:, i // rows] if i % rows else np.full(len(sets), i, np.uint64)
            keys[:, i // rows] = mixed(before * np.uint64(_BASE) + least)
        else:
            rest[:, i - bands * rows] = mixed(least)
    return keys.view(np.int64), rest
