"""Document fingerprints by Order MinHash.

A text's k-mers are numbered by occurrence (the second "abc" is another item
than the first). In each round the items are ranked by a hash of their own; the
`order` smallest are put back into the order in which they stand in the text,
and a hash of that tuple is the round's lane. Two lanes agree only if the same
items were drawn in the same order, so the share of agreeing lanes follows the
edit distance, not only the common content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listing_engine.llm.shared import code_points, kept, mixed, table, window_hashes


@lru_cache
def _factors(lanes: int) -> np.ndarray:
    seeds = mixed(np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds.astype(np.uint32) | np.uint32(1))[:, None]


@lru_cache
def _room(n: int) -> np.ndarray:
    """Memory that every text of a worker uses again; a fresh array costs more than the ranking."""
    return np.empty(n, np.uint32)


@dataclass(frozen=True)
class OrderMinHash:
    """k: code points of a k-mer; order: items of a tuple; lanes: rounds, 16 bits each.

    A text of fewer than `k` code points is one k-mer, the empty text has none
    (all lanes 0). Tuples of texts with fewer than `order` items hold what there is.
    """

    k: int = 8
    order: int = 2
    lanes: int = 64
    block: int = 1024  # items ranked at a time, so that the ranks stay in the cache

    def _rounds(self) -> tuple[np.ndarray, np.ndarray]:
        """An odd factor for each lane, and room for the ranks of a block."""
        return _factors(self.lanes), _room(self.lanes * self.block)

    def signature(self, text: str) -> np.ndarray:
        """The lanes of a text as uint16."""
        codes = code_points([text])
        if not len(codes):
            return np.zeros(self.lanes, np.uint16)
        grams = window_hashes(codes, min(self.k, len(codes)))
        # sorted by hash, then position: equal k-mers stand together in text order
        ordered = np.sort((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64))
        position, gram = ordered.astype(np.uint32), (ordered >> np.uint64(32)).astype(np.uint32)
        index = np.arange(len(gram), dtype=np.uint32)
        first = np.ones(len(gram), bool)
        np.not_equal(gram[1:], gram[:-1], out=first[1:])
        nth = index - np.maximum.accumulate(np.where(first, index, np.uint32(0)))
        item = gram + nth * np.uint32(0x85EBCA6B)
        item ^= item >> np.uint32(15)

        factor, room = self._rounds()
        take = min(self.order, len(item))
        row = np.arange(self.lanes)
        ranks, at = [], []
        for start in range(0, len(item), self.block):
            items = item[None, start : start + self.block]
            rank = room[: self.lanes * items.shape[1]].reshape(self.lanes, -1)
            np.multiply(items, factor, out=rank)
            for _ in range(min(take, rank.shape[1])):
                best = rank.argmin(axis=1)
                ranks.append(rank[row, best])
                at.append(best + start)
                rank[row, best] = 0xFFFFFFFF
        ranks, at = np.stack(ranks, axis=1), np.stack(at, axis=1)
        best = np.take_along_axis(at, np.argsort(ranks, axis=1, kind="stable")[:, :take], axis=1)
        best = np.take_along_axis(best, np.argsort(position[best], axis=1), axis=1)
        lane = np.zeros(self.lanes, np.uint64)
        for j in range(take):
            lane = mixed(lane * np.uint64(31) + item[best[:, j]] + np.uint64(j + 1))
        return (lane >> np.uint64(16)).astype(np.uint16)


def fingerprint(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing lanes, 0 to 1."""
    return float(np.mean(a == b))


def edited(text: str, other: str) -> str:
    """`text` with its last half replaced by as much of the start of `other`."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


PAIR = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
# a row that waits for its neighbour in another partition: its place and its text
SEAM = [("part", pa.int32()), ("role", pa.string()), ("text", pa.string())]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair(method: OrderMinHash, doc: tuple, following: tuple) -> dict:
    """doc, following: (doc_id, text, signature)."""
    changed = edited(doc[1], following[1])
    sign = method.signature(changed)
    return {
        "doc_id": doc[0],
        "n_chars": len(doc[1]),
        "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": fingerprint(doc[2]),
        "edited_fingerprint": fingerprint(sign),
        "near_edited": likeness(doc[2], sign),
        "near_next": likeness(doc[2], following[2]),
    }


def neighbour_fingerprints(docs: DataFrame, method: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Fingerprint each text, its edited text, and compare it with the next document's.

    "Next" goes by ascending doc_id (nulls first, equal ids by text; after the
    last comes the first, which may be the document itself). One range shuffle
    puts neighbours side by side; a task hands on all its rows but the last one,
    which waits with its text for the first row of the next non-empty partition.
    Only these two rows a partition are joined afterwards. Null texts count as
    empty; an empty table gives no row; further columns are ignored.
    """

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        blank = {f.name: None for f in PAIR}
        schema = pa.schema([*PAIR, *SEAM])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                now = (doc_id, text, method.signature(text))
                if last is None:
                    rows.append({**blank, "doc_id": doc_id, "part": part, "role": "head", "text": text})
                else:
                    rows.append(_pair(method, last, now))
                last = now
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{**blank, "doc_id": last[0], "part": part, "role": "tail", "text": last[1]}], schema=schema)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc, following = (r["doc_id"], r["text"]), (r["next_id"], r["next_text"])
                rows.append(_pair(method, (*doc, method.signature(doc[1])), (*following, method.signature(following[1]))))
            yield pa.RecordBatch.from_pylist(rows, schema=PAIR)

    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    rows = kept(ordered.mapInArrow(along, f"{RESULT}, part int, role string, text string"))
    seams = rows.filter(F.col("role").isNotNull()).select("doc_id", "part", "role", "text")
    heads = seams.filter("role = 'head'")
    parts = heads.select("part")  # one number a partition
    following = parts.select(
        "part",
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part"))).alias("next_part"),
    )
    pairs = (
        seams.filter("role = 'tail'")
        .join(following, "part")
        .join(heads.select(F.col("part").alias("next_part"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")), "next_part")
        .select("doc_id", "text", "next_id", "next_text")
        .mapInArrow(across, RESULT)
    )
    return rows.filter(F.col("role").isNull()).drop("part", "role", "text").unionByName(pairs)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE: dict[str, str] = {}
