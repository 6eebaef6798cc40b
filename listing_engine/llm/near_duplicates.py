"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints only; copies are one node. Fingerprints that differ in at
most d of 64 bits agree in some `b - d` of b blocks, so each fingerprint is
dealt to one bucket for each choice of agreeing blocks. A task sorts its share
by bucket and by the Gray rank of the bits, with the agreeing blocks in front,
and builds nodes over runs of neighbours: a node keeps the bits that all below
it share. Two nodes whose shared bits already differ in more than d places have
no pair between them and are pruned as a whole; what is left is compared at the
leaves. A task hands on a star for each connected set that it finds, never its
pairs; stars are joined to components by alternating star contraction.

near_duplicates() links 64-bit fingerprints at a fixed distance. Texts of which
four fifths of the shingles agree mostly differ in more bits than any choice of
agreeing blocks allows for, so similar_texts() takes 256 bits of the distinct
shingles, deals fingerprints by sampled bits, and searches with the same index
for candidates only: each pair of candidates is then compared by its shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType
from xxhash import xxh64_intdigest

from listing_engine.llm import sets
from listing_engine.llm.confirm import Near, confirmed_links
from listing_engine.llm.shared import UPPER, kept, mixed, table

DISTANCE = 4
WORDS = 4
SEED = 42
#: Fingerprints of a bucket that one task compares; larger buckets are dealt out as pairs of parts.
PART = 8192
#: Cells of up to so many fingerprints need no index.
SMALL = 32
#: similar_texts(): shingle length, share of common shingles, 64-bit words of a fingerprint.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
WIDE = 4
#: Standard deviations of the differing bits that are allowed beyond their mean at SIMILARITY:
#: where most pairs are similar, and for candidates, of which only shingles decide.
SLACK = 0.9
CANDIDATE_SLACK = 3.5
#: Chance that no sampled bucket holds a pair that differs in the mean number of bits at SIMILARITY.
MISSED = 1e-5
WIDE_PART = 32_768
#: Texts of up to so many distinct shingles also meet by bands of MinHash rows: few shingles make
#: the differing bits less regular.
SHORT = 50
SHORT_ROWS, SHORT_MISSED = 4, 1e-6
#: Texts of a set of candidates that one task compares (in cells of two parts twice as many).
EXACT_PART = 1024
#: The id of texts without a doc_id.
NO_ID = (1 << 63) - 1
#: Texts around which a task links all others of a cell before it searches the rest.
CENTRES = 16
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Runs of `words` words, A-Z lower-cased, repeats included; fewer words: all of them; none: no shingle."""
    # the default separators of bytes.split are \x20 and \x09-\x0D
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return []
    line, n = b" ".join(found), min(words, len(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - n + 1]
    return [line[a:b] for a, b in zip(starts.tolist(), (ends[n - 1 :] - 1).tolist())]


def simhash(text: str) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no shingle: 0."""
    hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles(text)], "<u8")
    bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def simhash_column(texts: pa.Array) -> pa.Array:
    signed = np.array([simhash(t.as_py() or "") for t in texts], np.uint64).view(np.int64)
    return pa.array(signed)


_SEEDS = np.random.default_rng(SEED).integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_print(members: np.ndarray) -> bytes:
    """64 * WIDE bits over the hashes of a set: 1 where over half of them have it set; no member: all bits 0."""
    bits = np.zeros(64 * WIDE, np.int64)
    for start in range(0, len(members), 255):  # so that bytes can hold the counts
        block = mixed(members[start : start + 255, None] * _SEEDS).view(np.uint8)
        bits += np.add.reduce(np.unpackbits(block, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(members), bitorder="little").tobytes()


def wide_simhash(text: str, words: int = SIMILAR_WORDS) -> bytes:
    """The wide fingerprint of the distinct shingles of a text."""
    return wide_print(sets.shingle_sets([text], words)[0])


def _wide(bands: int):
    """From rows (doc_id, text_hash, text): name and size of the set of distinct shingles, its wide
    fingerprint, and for short sets the keys of `bands` bands."""

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sets.text_parts(batches):
            found = sets.shingle_sets(texts, SIMILAR_WORDS)
            short = [s for s in found if 0 < len(s) <= SHORT]
            own = iter(sets.signatures(short, bands, SHORT_ROWS, 0)[0] if short else ())
            columns = [
                rows.column("doc_id"),
                rows.column("text_hash"),
                pa.array([sets.set_name(s) for s in found], pa.int64()),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([wide_print(s) for s in found], pa.binary()),
                pa.array([next(own) if 0 < len(s) <= SHORT else None for s in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "name", "n", "print", "keys"])

    return wide


def differing(codes: np.ndarray) -> np.ndarray:
    """Bits that are set, added up over the words of the last axis."""
    count = np.bitwise_count(codes)
    return count[..., 0] if codes.shape[-1] == 1 else count.sum(axis=-1, dtype=np.uint16)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in Gray order, in which neighbours differ in one bit."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Nodes over fingerprints of one cell in Gray order; level 0 holds leaves of `leaf` fingerprints.

    codes: rows of 64-bit words. A node is (shared, pattern, set): the mask of
    the bits in which all fingerprints below agree, their values there, and the
    number of the set that all of them are known to belong to (-1: none).
    """

    def __init__(self, codes: np.ndarray, leaf: int = 32, fan: int = 8, sets: np.ndarray | None = None):
        self.codes, self.leaf, self.fan = codes.reshape(len(codes), -1), leaf, fan
        sets = np.full(len(codes), -1) if sets is None else sets
        at = np.arange(0, len(codes), leaf)
        ones, some = np.bitwise_and.reduceat(self.codes, at), np.bitwise_or.reduceat(self.codes, at)
        low, high = np.minimum.reduceat(sets, at), np.maximum.reduceat(sets, at)
        self.levels = [(~(ones ^ some), ones, np.where(low == high, low, -1))]
        while len(ones) > 1:
            at = np.arange(0, len(ones), fan)
            ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((~(ones ^ some), ones, np.where(low == high, low, -1)))

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j) of pairs within `distance`, a bounded block at a time; pairs inside a known set may be left out.

        The tree is walked from the top against itself; a pair of nodes is
        dropped once the bits that both sides share differ in more than
        `distance` places, or where both belong to one set.
        """
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, bits, sets = self.levels[level]
            near = differing((bits[a] ^ bits[b]) & mask[a] & mask[b]) <= distance
            near &= (a <= b) & ((sets[a] != sets[b]) | (sets[a] < 0))
            a, b = a[near], b[near]
            if level:
                wide, step = len(self.levels[level - 1][0]), np.arange(self.fan)
                one = (a[:, None, None] * self.fan + step[:, None] + np.zeros(self.fan, np.int64)).ravel()
                two = (b[:, None, None] * self.fan + step + np.zeros((self.fan, 1), np.int64)).ravel()
                real = (one < wide) & (two < wide)
                a, b = one[real], two[real]
        rows, last = np.arange(self.leaf), len(self.codes) - 1
        block = max(1, 512 // self.codes.shape[1])
        for start in range(0, len(a), block):
            i = a[start : start + block, None] * self.leaf + rows
            j = b[start : start + block, None] * self.leaf + rows
            x, y = self.codes[np.minimum(i, last)], self.codes[np.minimum(j, last)]
            n, u, v = np.nonzero(differing(x[:, :, None] ^ y[:, None, :]) <= distance)
            left, right = i[n, u], j[n, v]
            real = (left <= last) & (right <= last) & (left < right)
            yield left[real], right[real]


class Union:
    """Connected sets of the positions that a task meets; the smallest position leads."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook larger leaders to smaller ones and shorten the ways, until both ends agree."""
        while len(a):
            self._flatten()
            x, y = self.parent[a], self.parent[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(self.parent, high, low)

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def leaders(self) -> np.ndarray:
        self._flatten()
        return self.parent


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of nearly even blocks of 64 bits."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cut[:-1], cut[1:])]


def blocks_for(n: int, distance: int) -> int:
    """Blocks so that a bucket of evenly spread fingerprints stays small at any size."""
    blocks = distance + 2
    while n >> (64 * (blocks - distance) // blocks) > 16 and blocks < distance + 8:
        blocks += 1
    return blocks


def bucket_column(fingerprint: Column, chosen: tuple[int, ...], bounds: list[tuple[int, int]]) -> Column:
    """The bits of the chosen blocks, put together, as one number."""
    key = F.lit(0).cast("long")
    for c in chosen:
        first, width = bounds[c]
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return key


def star_links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect all fingerprints that are linked, as stars.

    fingerprints: one column `fp` of distinct longs, read more than once.
    Buckets with more than PART fingerprints are split: each part meets each
    part in a task of its own, so no task holds a whole hot bucket.
    """
    n = fingerprints.count()
    blocks = blocks_for(n, distance)
    bounds = block_bounds(blocks)
    choices = list(combinations(range(blocks), blocks - distance))
    dealt = fingerprints.select(
        "fp",
        F.explode(F.array([F.struct(F.lit(i).alias("choice"), bucket_column(F.col("fp"), c, bounds).alias("bucket")) for i, c in enumerate(choices)])).alias("k"),
    ).select("fp", "k.choice", "k.bucket")
    front = {i: _front_masks(c, bounds) for i, c in enumerate(choices)}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, group, fp in _cells(batches):
            yield from _search_cells(fp, _fronted(fp.view(np.uint64), front[choice])[:, None], group, distance)

    return _searched(dealt, "fp", PART, cells)


def _searched(dealt: DataFrame, node: str, part: int, search: Callable, schema: str = "a long, b long") -> DataFrame:
    """Distinct rows that `search` finds in the cells of `dealt` (node, choice, bucket, ...).

    Buckets with more than `part` rows are split: each part meets each part in a
    task of its own, so no task holds a whole hot bucket.
    """
    hot = kept(dealt.groupBy("choice", "bucket").count().filter(F.col("count") > part).select("choice", "bucket", F.ceil(F.col("count") / part).cast("int").alias("parts")))
    if hot.isEmpty():
        spread = dealt.withColumn("cell", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64(node), "parts")
        small, large = F.least(own, F.col("other")), F.greatest(own, F.col("other"))
        spread = (
            dealt.join(hot, ["choice", "bucket"], "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
            .select(*dealt.columns, (small * F.col("parts") + large).alias("cell"))
        )
    return (
        spread.repartition("choice", "bucket", "cell")
        .sortWithinPartitions("choice", "bucket", "cell")
        .mapInArrow(search, schema)
        .distinct()
    )


def wide_distance(similarity: float, slack: float = SLACK) -> tuple[float, int]:
    """(share of bits, bits allowed) in which fingerprints of such texts differ: sets of equal
    size with Jaccard s have the cosine 2s/(1+s), and a bit differs with chance angle/pi."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return share, round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def wide_samples(n: int, share: float) -> np.ndarray:
    """Sampled bits, one row a table: more bits where more texts share the buckets, and so
    many tables that a pair at `share` meets in one of them but for the chance MISSED."""
    width = max(10, math.ceil(math.log2(max(n, 1))) - 8)
    tables = math.ceil(math.log(MISSED) / math.log(1 - (1 - share) ** width))
    return np.array([np.random.default_rng(t).choice(64 * WIDE, width, replace=False) for t in range(tables)])


def candidate_sets(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """bucket, name: sets of nodes that are connected by candidate pairs in some cell.

    nodes: name (distinct longs) and print (wide fingerprints), read more than
    once. A set that many cells find has one bucket, named by its members.
    """
    share, distance = wide_distance(similarity, CANDIDATE_SLACK)
    samples = wide_samples(nodes.count(), share)
    weights = 1 << np.arange(samples.shape[1], dtype=np.int64)

    @F.arrow_udf(ArrayType(LongType()))
    def buckets(prints: pa.Array) -> pa.Array:
        bits = np.unpackbits(_words(prints).view(np.uint8), axis=1, bitorder="little")
        keys = np.stack([bits[:, s].astype(np.int64) @ weights for s in samples], axis=1)
        ends = np.arange(0, keys.size + 1, len(samples), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, name, print_ in _cells(batches, ("name", "print"), 1 << 14):
            for star in _search_cells(name, print_, group, distance):
                lead, member = star.column("b").to_numpy(), star.column("a").to_numpy()
                member, lead = np.concatenate((member, np.unique(lead))), np.concatenate((lead, np.unique(lead)))
                order = np.lexsort((member, lead))
                member, lead = member[order], lead[order]
                cut = np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1])))
                ends = np.append(cut[1:], len(lead))
                bucket = [sets.set_name(member[a:b]) for a, b in zip(cut.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, ends - cut)), pa.array(member)], names=["bucket", "name"])

    dealt = nodes.select("name", "print", F.posexplode(buckets("print")).alias("choice", "bucket"))
    return _searched(dealt, "name", WIDE_PART, cells, "bucket long, name long")


def _near_prints(similarity: float) -> Near:
    """Pairs of sets whose sizes allow for the similarity, and whose fingerprints do, unless both are short."""
    distance = wide_distance(similarity, CANDIDATE_SLACK)[1]

    def near(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, prints = rows["n"], rows["values"]
        left = np.flatnonzero(np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        short = np.maximum(n[i[left]], n[j[left]]) <= SHORT
        close = np.bitwise_count(prints[i[left]] ^ prints[j[left]]).sum(axis=1, dtype=np.uint16) <= distance
        return left[short | close]

    return near


def _words(prints: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(prints.to_pylist()), "<u8").reshape(-1, WIDE)


def _front_masks(chosen: tuple[int, ...], bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first bit, width) of all blocks, the chosen ones in front."""
    return [bounds[c] for c in chosen] + [b for i, b in enumerate(bounds) if i not in chosen]


def _fronted(fp: np.ndarray, layout: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for first, width in layout:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(first)) & np.uint64((1 << width) - 1))
    return out


def _cells(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("fp",), rows: int = 1 << 16) -> Iterator[tuple]:
    """(choice, cell number, named columns) of runs of whole cells with one choice, about `rows` rows at a time."""
    held: list[tuple] = []

    def runs(columns: tuple, all_of_it: bool):
        choice, bucket, cell, *values = columns
        new = np.flatnonzero((choice[1:] != choice[:-1]) | (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
        stop = len(choice) if all_of_it else (new[-1] if len(new) else 0)
        group = np.zeros(len(choice), np.int64)
        group[new] = 1
        group = np.cumsum(group)
        for a, b in _pieces(choice[:stop]):
            yield int(choice[a]), group[a:b], *(v[a:b] for v in values)
        held[:] = [tuple(c[stop:] for c in columns)]

    for batch in batches:
        columns = (batch.column(c) for c in ("choice", "bucket", "cell", *names))
        held.append(tuple(_words(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in columns))
        if sum(len(h[0]) for h in held) >= rows:
            yield from runs(tuple(np.concatenate(c) for c in zip(*held)), False)
    if held and sum(len(h[0]) for h in held):
        yield from runs(tuple(np.concatenate(c) for c in zip(*held)), True)


def _pieces(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        yield from zip(cut[:-1], cut[1:])


def _search_cells(node: np.ndarray, code: np.ndarray, group: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of the nodes whose codes (rows of words) are linked in each cell.

    Cells of two parts hold their own copies of both, so a pair inside a part is
    found more than once at most; it costs time, not correctness.
    """
    order = np.lexsort((gray_rank(code[:, 0]), group))
    node, code, group = node[order], code[order], group[order]
    union = Union(len(code))
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    small = np.repeat(size <= SMALL, size)
    found = []
    for step in range(1, SMALL):  # small cells, all at once: each row with the one `step` places on
        i = np.flatnonzero((group[step:] == group[:-step]) & small[:-step]) if step < len(code) else ()
        if not len(i):
            break
        i = i[differing(code[i] ^ code[i + step]) <= distance]
        found.append((i, i + step))
    if found:
        union.join(*map(np.concatenate, zip(*found)))
    for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        own = code[a : a + n]
        sets = _centred(own, distance)
        member = np.flatnonzero(sets >= 0)
        union.join(a + member, a + sets[member])
        place = np.argsort(sets, kind="stable")  # known sets lie together, each in Gray order
        for i, j in GrayIndex(own[place], sets=sets[place]).links(distance):
            union.join(a + place[i], a + place[j])
    lead = union.leaders()
    away = lead != np.arange(len(lead))
    if away.any():
        yield pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(node[lead[away]])], ["a", "b"])


def _centred(codes: np.ndarray, distance: int) -> np.ndarray:
    """For each row a row within `distance` that it is linked to (itself for a centre; -1: none found yet).

    A group of copies needs few centres; its rows are then known as one set and
    aren't compared with each other. What no centre reaches is left to the index.
    """
    sets = np.full(len(codes), -1)
    for centre in np.linspace(0, len(codes) - 1, CENTRES).astype(int):
        free = np.flatnonzero(sets < 0)
        if sets[centre] < 0:
            reached = free[differing(codes[free] ^ codes[centre]) <= distance]
            sets[reached] = centre
    return sets


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps: every round hooks all
    neighbours of a node to the smallest one. Each step is a grouped minimum
    (partly summed before its shuffle) and a join, which Spark may split where a
    node is hot. Rounds end when no edge changes; each round's edges go to the
    checkpoint folder.
    """
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = kept(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges, to see whether a round changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (long), component_id of every row of `docs`.

    Texts whose fingerprints are linked directly or through others share the
    smallest doc_id among them. Null and empty texts have fingerprint 0 and are
    linked like any other; repeated rows stay; null doc_ids are least; an empty
    table gives no row; further columns are ignored.
    """
    prints = kept(docs.select("doc_id", simhash_column("text").alias("fp")))
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(star_links(nodes.select("fp"), distance))
    sets = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = sets.groupBy("root").agg(F.min("first").alias("component_id"))
    named = sets.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, text_hash and name (of the set of shingles) of every row, and for each name the
    smallest (id, name) among all that it is linked with; a null doc_id is the largest id."""
    bands = math.ceil(math.log(SHORT_MISSED) / math.log(1 - similarity**SHORT_ROWS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = kept(texts.mapInArrow(_wide(bands), "doc_id long, text_hash long, name long, n long, print binary, keys array<long>"))
    nodes = kept(
        rows.groupBy("name").agg(
            F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("keys").alias("keys")
        )
    )
    known = nodes.select("name", "n", F.col("print").alias("values"))
    dealt = kept(candidate_sets(nodes.select("name", "print"), similarity).unionByName(nodes.select("name", F.explode("keys").alias("bucket"))))
    links = confirmed_links(sets.members_of(docs, SIMILAR_WORDS), dealt, known, _near_prints(similarity), components, round(100 * similarity), part=EXACT_PART)
    ids = nodes.select("name", F.struct("id", "name").alias("node"))
    ends = links.join(ids.select(F.col("name").alias("a"), F.col("node").alias("x")), "a").join(ids.select(F.col("name").alias("b"), F.col("node").alias("y")), "b")
    roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node.name").alias("name"), "root")
    return rows.select("doc_id", "text_hash", "name"), ids.join(roots, "name", "left").select("name", F.coalesce("root", "node").alias("root"))


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id of every row of `docs`.

    Texts are linked if `similarity` of their distinct five-word shingles agree
    (Jaccard; fewer words: the whole text); component_id is the smallest doc_id
    reached (null, if none of them has one). Wide fingerprints find candidates,
    short texts are candidates by bands of MinHash rows, too; every candidate pair
    is then compared by 64-bit hashes of all its shingles, before sets are closed.
    Of pairs at exactly 0.8 about one in a thousand is no candidate, far fewer
    above. Texts with no word (null too) are one group. Rows of one doc_id are
    judged each by its own text; repeated rows stay; very long texts are taken
    whole, one at a time; an empty table gives no row; further columns are ignored.
    """
    rows, classes = _classes(docs, similarity)
    return rows.join(classes, "name").select("doc_id", F.nullif("root.id", F.lit(NO_ID)).alias("component_id"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each set of similar texts: one with the smallest doc_id.

    Rows are told apart by doc_id and text, so other texts under the same doc_id
    stay; of rows that repeat both one stays. Rows without a doc_id go where a
    similar text has one, else one of them stays.
    """
    rows, classes = _classes(docs, similarity)
    leads = classes.filter("root.name = name").select("name", F.col("root.id").alias("id"))
    own = rows.select("name", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash")
    leads = own.join(leads, ["name", "id"]).groupBy("name", "id").agg(F.min("text_hash").alias("text_hash")).select("id", "text_hash")
    where = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # clear of clashing names
    chosen = docs.select(*(F.col(c).alias(v) for c, v in where.items()))
    chosen = chosen.withColumn("id", F.coalesce(F.col(where["doc_id"]).cast("long"), F.lit(NO_ID))).withColumn("text_hash", F.xxhash64(where["text"]))
    chosen = chosen.join(leads, ["id", "text_hash"], "left_semi")
    if not own.groupBy("id", "text_hash").count().filter("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["id", "text_hash"])
    return chosen.select(*(F.col(v).alias(c) for c, v in where.items()))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLE: dict[str, str] = {}
