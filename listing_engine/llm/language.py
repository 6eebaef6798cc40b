"""Language ID by language-bitmask n-gram filters.

A Bloom filter for each language holds the n-grams that are usual in it. The
filters are bit-sliced: one array has, for each filter position, a word with
one bit a language, so a few look-ups and an AND return all languages that
contain an n-gram. A text's languages are counted over its n-grams (a popcount
a language), corrected for the filters' false positives, and the most frequent
one is the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.llm.shared import code_points, mixed, table, window_hashes

SIZES = (3, 4)
#: Documents of each language that the filters are fitted on, at most.
SAMPLE = 1500
#: Languages at most: bits of a filter word.
LANGUAGES = 64
NONE = "und"


def _folded(codes: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1; runs of everything but letters as blanks, one each."""
    small = np.where((codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7), codes + np.uint32(32), codes)
    letter = (small >= 97) & (small <= 122) | (small == 0xAA) | (small == 0xB5) | (small == 0xBA) | (small >= 0xC0) & (small != 0xF7)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    return np.where(letter, small, np.uint32(32))[kept].astype(np.uint32)


def ngrams(text: str, sizes: Sequence[int] = SIZES) -> np.ndarray:
    """Hashes of the n-grams of a text, word by word with a blank on both sides."""
    codes = _folded(code_points([f" {text} "]))
    codes = np.concatenate((np.full(1, 32, np.uint32), codes))
    blank = np.concatenate(([0], np.cumsum(codes == 32)))
    found = []
    for n in sizes:
        h = window_hashes(codes, n)
        inner = blank[n - 1 : n - 1 + len(h)] - blank[1 : 1 + len(h)]  # blanks apart from the first and last sign
        found.append(h[inner == 0] ^ np.uint64(n))
    return np.concatenate(found)


@dataclass(frozen=True)
class BitSlicedFilters:
    """languages: by bit; words: one per filter position; wrong: each language's false-positive rate; probes: look-ups an n-gram."""

    languages: tuple[str, ...]
    words: np.ndarray
    wrong: np.ndarray
    probes: int = 3

    @staticmethod
    def positions(grams: np.ndarray, size: int, probes: int) -> list[np.ndarray]:
        """Positions by double hashing; size is a power of two."""
        h = mixed(grams)
        one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return [((one + np.uint64(i) * two) & np.uint64(size - 1)).astype(np.int64) for i in range(probes)]

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], bits_each: int = 12, probes: int = 3) -> BitSlicedFilters:
        """Filters of `bits_each` positions for each n-gram of the largest set."""
        names = tuple(sorted(grams))
        if len(names) > LANGUAGES:
            raise ValueError(f"{len(names)} languages; the filter words have {LANGUAGES} bits")
        size = 1 << max(10, (bits_each * max((len(g) for g in grams.values()), default=1)).bit_length())
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(names) <= np.iinfo(k).bits), np.uint64)
        words = np.zeros(size, kind)
        for bit, name in enumerate(names):
            for at in cls.positions(grams[name], size, probes):
                words[at] |= kind(1 << bit)
        filled = np.array([np.mean((words >> kind(bit)) & kind(1)) for bit in range(len(names))])
        return cls(names, words, filled**probes, probes)

    def contains(self, grams: np.ndarray) -> np.ndarray:
        """A word for each n-gram: a bit for each language whose filter has it."""
        at = self.positions(grams, len(self.words), self.probes)
        found = self.words[at[0]]
        for more in at[1:]:
            found = found & self.words[more]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its share of the corrected counts); `und`, 0 if the text has no letter.

        A text whose n-grams are in no filter goes to the first language, with score 0.
        """
        if not text or not self.languages:
            return NONE, 0.0
        grams = ngrams(text)
        if not len(grams) or not any(c.isalpha() for c in text):
            return NONE, 0.0
        counts = np.zeros(len(self.languages))
        for start in range(0, len(grams), 1 << 16):
            found = self.contains(grams[start : start + (1 << 16)])
            # words are few in kind: count each kind once, then its bits
            kinds, number = np.unique(found, return_counts=True) if found.itemsize > 2 else _counted(found)
            for bit in range(len(counts)):
                counts[bit] += number[(kinds >> kinds.dtype.type(bit)) & kinds.dtype.type(1) == 1].sum()
        right = np.maximum(counts - len(grams) * self.wrong, 0) / np.maximum(1 - self.wrong, 1e-9)
        best = int(right.argmax())
        return self.languages[best], float(right[best] / right.sum()) if right.sum() else 0.0


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = np.bincount(found)
    kinds = np.flatnonzero(number)
    return kinds, number[kinds]


def fit(texts: Sequence[str], languages: Sequence[str]) -> BitSlicedFilters:
    """Filters over the n-grams that are more usual in a language than in the others' average.

    An n-gram belongs to a language if its share of that language's n-grams is
    over the mean share of all languages and it occurs in two texts or more (in
    one, where the language has fewer than 20 texts). Languages count evenly,
    however many texts each has.
    """
    names = sorted(set(languages))
    held: dict[str, list[np.ndarray]] = {name: [] for name in names}
    for text, name in zip(texts, languages):
        held[name].append(np.unique(ngrams(text)))
    grams, shares = {}, {}
    for name in names:
        g, n = np.unique(np.concatenate(held[name]), return_counts=True) if held[name] else (np.zeros(0, np.uint64), np.zeros(0))
        often = n >= (2 if len(held[name]) >= 20 else 1)
        held[name] = []
        grams[name], shares[name] = g[often], n[often] / max(n.sum(), 1)
    if len(names) > 1 and sum(map(len, grams.values())):
        every = np.unique(np.concatenate(list(grams.values())))
        total = np.zeros(len(every))
        for name in names:
            total[np.searchsorted(every, grams[name])] += shares[name]
        for name in names:
            at = np.searchsorted(every, grams[name])
            grams[name] = grams[name][shares[name] > total[at] / len(names)]
    return BitSlicedFilters.build(grams)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_table(docs: DataFrame, sample: int = SAMPLE) -> BitSlicedFilters:
    """Fit on documents with text and lang that aren't held out: the `sample` rows of each lang with the lowest hashes.

    lang only labels the rows. The sample is drawn language by language with a
    bounded top-k, so no language's rows meet in one task.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    names = [r[0] for r in known.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    texts, languages = [], []
    for name in names:
        rows = known.filter(F.col("lang") == name).select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(sample)
        edge = rows.agg(F.max("h")).first()[0]
        chosen = known.filter((F.col("lang") == name) & (F.xxhash64("doc_id") <= edge)).select("doc_id", "text")
        for r in sorted(chosen.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))[: 2 * sample]:
            texts.append(r["text"])
            languages.append(name)
    return fit(texts, languages)


def predict_column(filters: BitSlicedFilters, text: Column) -> Column:
    """Struct (lang, score) of each whole text."""
    shared = _spark().sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return predict(text)


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`docs` with `lang_pred` and `score`.

    Null texts and texts without a letter get `und` and 0; so does every text if
    no row can be learned from. Repeated rows stay; columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    both = docs.select(*names, predict_column(fit_table(docs, sample), F.col("text")).alias("found__"))
    return both.select(*names, F.col("found__.lang").alias("lang_pred"), F.col("found__.score").alias("score"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
