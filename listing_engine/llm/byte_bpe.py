"""Byte-level BPE by corpus-level merge replay.

A task takes the distinct words of its rows as one corpus. An inverted index
from the token that a pair would become to the places of such pairs lets every
merge be applied to all words at once, in rank order; a merge touches only the
pairs to its left and right. Words met before come from a bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from listing_engine.llm.shared import table, text_blocks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words whose ids a worker remembers, half of them as newer ones; when these are full, the older ones go
#: that weren't met since (results don't depend on it).
REMEMBERED = 240_000
#: Bytes of text whose words are replayed together; more don't fit the processor's caches.
BLOCK = 1 << 18


class Replay:
    """Ranks of a vocabulary and the merge replay over any set of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merged: dict[int, int] = {}

    def ids(self, words: Iterable[bytes]) -> list[list[int]]:
        """Token ids of each word by merges alone."""
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.packed_ids(words)]

    def packed_ids(self, words: Iterable[bytes]) -> list[bytes]:
        """Token ids of each word by merges alone, as little-endian unsigned 32-bit integers.

        The next merge is always the lowest rank that occurs in any word; equal
        ranks go from left to right. If a merge lets a lower rank appear in its
        word, the word's further places wait until that one is done, so each
        word sees its merges exactly as if it were encoded alone.
        """
        words = list(words)
        lengths = np.array([len(w) for w in words], np.int64)
        signs = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(signs), np.cumsum(lengths)
        ids = self.single[signs].tolist()
        word_of = np.repeat(np.arange(len(words)), lengths)
        # no pair crosses a word's end; place n stands for "none" on both sides
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends[lengths > 0] - 1] = n
        left[(ends - lengths)[lengths > 0]] = n
        ranks = np.where(right[:-1] < n, self.first[signs[:-1].astype(np.int64) << 8 | signs[1:]], -1) if n else np.zeros(0, np.int64)
        right, left, word_of = right.tolist(), left.tolist(), word_of.tolist()
        # the inverted index: what a pair would become -> places of such pairs, in ascending order
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        heap, at = np.unique(ranks[places], return_index=True)
        index = dict(zip(heap.tolist(), map(np.ndarray.tolist, np.split(places, at[1:])))) if len(heap) else {}
        heap = heap.tolist()  # sorted, hence a heap
        becomes, rank_of, token = self.merged, self.ranks.get, self.token
        known = becomes.get
        ids.append(-1)
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            waiting = -1
            for p in places:
                a = ids[p]
                if a < 0:
                    continue  # an earlier merge took it
                q = right[p]
                b = ids[q]
                if b < 0:
                    continue
                key = a << 20 | b
                new = known(key)
                if new is None:
                    new = becomes[key] = rank_of(token[a] + token[b], -1)
                if new != r:
                    continue
                if word_of[p] == waiting:
                    if r not in index:
                        heappush(heap, r)
                    index.setdefault(r, []).append(p)
                    continue
                ids[p], ids[q] = r, -1
                after = right[p] = right[q]
                if after < n:
                    left[after] = p
                    key = r << 20 | ids[after]
                    new = known(key)
                    if new is None:
                        new = becomes[key] = rank_of(token[r] + token[ids[after]], -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                        if new < r:
                            waiting = word_of[p]
                before = left[p]
                if before < n:
                    key = ids[before] << 20 | r
                    new = known(key)
                    if new is None:
                        new = becomes[key] = rank_of(token[ids[before]] + token[r], -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heappush(heap, new)
                        if new < r:
                            waiting = word_of[p]
        if len(becomes) > 2 * REMEMBERED:
            becomes.clear()
        left_over = np.array(ids[:-1], np.int64)
        stays = left_over >= 0
        packed = left_over[stays].astype("<u4").tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], ends))]).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older, rank_of = self.known, self.older, self.ranks.get
        merge, signs = [], []
        for word in set().union(*split).difference(known):
            found = older.get(word)
            if found is not None:
                known[word] = found
                continue
            data = word.encode("utf-8", "surrogatepass")
            rank = rank_of(data)
            if rank is None:
                merge.append(word)
                signs.append(data)
            else:  # a word that is a token stays whole
                known[word] = rank.to_bytes(4, "little")
        known.update(zip(merge, self.packed_ids(signs)))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_replays: dict[str, Replay] = {}


def _replay(vocabulary: bytes, pattern: str) -> Replay:
    """One replay a worker process for each vocabulary and pattern."""
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _replays:
        rows = (line.split() for line in vocabulary.splitlines() if line.strip())
        _replays[key] = Replay({base64.b64decode(a): int(b) for a, b in rows}, pattern)
    return _replays[key]


def encoded(docs: DataFrame, path: str | None = None, packed: bool = False, pattern: str | None = None) -> DataFrame:
    """`docs` with `ids` (array<int>), `n_tokens` (long) and `decoded` (the bytes that the ids stand for).

    packed: ids as bytes, each a little-endian unsigned 32-bit number. Null and
    empty texts have no ids and no bytes (both empty); repeated rows stay; very
    long texts are taken whole, one at a time; an empty table gives no row;
    columns of these names are replaced. The vocabulary's file is read once, on
    the driver; it is of fixed size (under 1 MB) and goes to the tasks as a
    broadcast value. Texts are encoded and decoded a block at a time, so a worker
    never holds the ids of a whole batch.
    """
    spark = docs.sparkSession
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    pattern = pattern or public_tokenizers.PATTERN
    docs = docs.drop("ids", "n_tokens", "decoded")
    at = docs.columns.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(shared.value, pattern)
        for batch in batches:
            done = 0
            for texts in text_blocks(batch.column(at), BLOCK):
                rows = batch.slice(done, len(texts))
                done += len(texts)
                found = [np.frombuffer(ids, "<u4") for ids in replay.encode(texts)]
                counts = np.array([len(ids) for ids in found], np.int64)
                if packed:
                    ids = pa.array([x.tobytes() for x in found], pa.binary())
                else:
                    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                decoded = pa.array([replay.decode(x) for x in found], pa.binary())
                new = [ids, pa.array(counts), decoded]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*batch.schema.names, "ids", "n_tokens", "decoded"])

    kinds = StructType(list(docs.schema.fields)).add("ids", BinaryType() if packed else ArrayType(IntegerType())).add("n_tokens", LongType()).add("decoded", BinaryType())
    return docs.mapInArrow(encode, kinds)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = encoded(docs, packed=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE: dict[str, str] = {}
