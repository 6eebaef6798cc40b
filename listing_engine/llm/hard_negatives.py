"""Hard-negative mining with exact scores from a residue-number-system product.

Components are whole numbers. Modulo a small prime they are so small that
float32 products and sums of them are exact, so the score matrix of a tile is
one float32 matrix product for each of a few primes; the exact signed scores
come back by Chinese remaindering. Rows are packed into blocks and anchors into
slots; each block meets each slot in one cell of a grid, so no task holds more
than a few blocks. Cells hand on the best few rows of an anchor only, and a
window over the anchor picks from these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listing_engine.llm.shared import kept, table

#: Whole steps of a component: x becomes floor(SCALE * x).
SCALE = 256
#: Rows of a packed block, anchors of a slot (about), blocks of a cell (about), anchors that are multiplied at once.
BLOCK, SLOT, CELL, SLICE = 4096, 1024, 8, 128
#: Residues come from primes below this, so that sums of CHUNK products of centred residues stay below 2**24.
LARGEST = 512
CHUNK = (1 << 24) // (LARGEST // 2) ** 2
#: 100 times a score fits a long.
REACH = 1 << 55
#: Residue matrices of a product.
KEPT = 5

PACKED = "block long, dims int, n int, ids binary, labels binary, anchors binary, parts binary"
ANCHORS = "block long, place int, dims int, anchor_id long, label long, vector binary"
NEAR = "block long, place int, anchor_id long, other_id long, score long"


def primes_for(reach: int) -> list[int]:
    """The largest primes below LARGEST whose product exceeds 2 * reach, so that scores in -reach .. reach are told apart."""
    chosen: list[int] = []
    for n in range(LARGEST - 1, 2, -1):
        if math.prod(chosen) > 2 * reach:
            return chosen
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            chosen.append(n)
    raise ValueError("scores don't fit a long")


def residue_product(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """left @ right.T modulo `prime` (0 .. prime - 1) by float32 products of centred residues."""

    def centred(x: np.ndarray) -> np.ndarray:
        return ((x + prime // 2) % prime - prime // 2).astype(np.float32)

    a, b = centred(left), centred(right)
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], CHUNK):
        total += (a[:, at : at + CHUNK] @ b[:, at : at + CHUNK].T).astype(np.int64)
    return total % prime


def exact_scores(left: np.ndarray, right: np.ndarray, primes: list[int]) -> np.ndarray:
    """left @ right.T as signed 64-bit numbers, put together from the residues (mixed radix)."""
    value, radix = residue_product(left, right, primes[0]), primes[0]
    for p in primes[1:]:
        digit = (residue_product(left, right, p) - value) * pow(radix, -1, p) % p
        value, radix = value + radix * digit, radix * p
    return np.where(value > radix // 2, value - radix, value)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, anchor, vector) as blocks of rows of one length."""
    first = TaskContext.get().partitionId() << 32
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    count = 0

    def block(dims: int) -> pa.RecordBatch:
        nonlocal count
        ids, labels, anchors, parts = (np.concatenate(c) for c in zip(*held.pop(dims)))
        count += 1
        values = [[first + count - 1], [dims], [len(ids)], [ids.tobytes()], [labels.tobytes()], [anchors.tobytes()], [parts.tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "dims", "n", "ids", "labels", "anchors", "parts"])

    for batch in batches:
        for start in range(0, len(batch), BLOCK // 4):
            part = batch.slice(start, BLOCK // 4)
            sizes = pc.list_value_length(part.column("vector")).to_numpy()
            flat = np.floor(SCALE * part.column("vector").flatten().to_numpy().astype(np.float64)).astype(np.int32)
            ends = np.cumsum(sizes)
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                parts = flat[(ends[own] - dims)[:, None] + np.arange(dims)]
                columns = (part.column(c).to_numpy(zero_copy_only=False)[own] for c in ("vec_id", "label", "anchor"))
                ids, labels, anchors = columns
                held.setdefault(dims, []).append((ids.astype(np.int64), labels.astype(np.int64), anchors.astype(np.uint8), parts.reshape(len(own), dims)))
                if sum(len(h[0]) for h in held[dims]) >= BLOCK:
                    yield block(dims)
    for dims in list(held):
        yield block(dims)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of packed blocks, one row each; (block, place) names a row of the table."""
    for batch in batches:
        for r in batch.to_pylist():
            place = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
            parts = np.frombuffer(r["parts"], np.int32).reshape(r["n"], r["dims"])[place]
            ids, labels = np.frombuffer(r["ids"], np.int64)[place], np.frombuffer(r["labels"], np.int64)[place]
            values = [[r["block"]] * len(place), place, [r["dims"]] * len(place), ids, labels, [p.tobytes() for p in parts]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "place", "dims", "anchor_id", "label", "vector"])


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The first `n` of `rows`: higher scores, then smaller ids."""
    if len(rows) > n:
        own = scores[rows]
        rows = rows[own >= np.partition(own, len(own) - n)[len(own) - n]]
    return rows[np.lexsort((ids[rows], -scores[rows]))[:n]]


def _tiles(anchors: pa.Table, blocks: pa.Table, primes: list[int]) -> Iterator[tuple]:
    """(anchor row, its scores, the block's number, ids and labels) for each anchor and block of a cell."""
    if not len(anchors):
        return
    dims = anchors.column("dims")[0].as_py()
    vectors = np.frombuffer(b"".join(anchors.column("vector").to_pylist()), np.int32).reshape(len(anchors), dims)
    rows = anchors.drop_columns(["vector"]).to_pylist()
    for i in range(len(blocks)):
        n, number = blocks.column("n")[i].as_py(), blocks.column("block")[i].as_py()
        ids, labels = (np.frombuffer(blocks.column(c)[i].as_py(), np.int64) for c in ("ids", "labels"))
        parts = np.frombuffer(blocks.column("parts")[i].as_py(), np.int32).reshape(n, dims)
        for at in range(0, len(rows), SLICE):
            for row, scores in zip(rows[at : at + SLICE], exact_scores(vectors[at : at + SLICE], parts, primes)):
                yield row, scores, number, ids, labels


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int32() if n == "place" else pa.int64()) for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))], names=names)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = KEPT, negatives: int = KEPT, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding. Components become floor(256 * x); a score
    is the whole-number inner product with the anchor, higher first, ties by
    smaller vec_id. Anchors are the rows where `anchor` holds; an anchor's
    positives are its first other rows of its label, and for each positive the
    first rows of other labels with low * positive <= 100 * negative <= high *
    positive are returned (all, if fewer). Rows with a null vec_id, label,
    vector or component or a non-finite component take no part; rows of other
    lengths aren't compared. Repeated rows are rows of their own, also as
    anchors; an empty table gives no row; further columns are ignored. Scores
    of 2**55 or more raise ValueError.
    """
    usable = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = (
        vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"))
        .filter("vec_id is not null and label is not null and vector is not null")
        .filter(usable)
    )
    largest, longest = clean.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(F.floor(SCALE * x).cast("double"))))), F.max(F.size("vector"))).first()
    reach = max(1, int(largest or 0) ** 2 * (longest or 0))
    if reach >= REACH:
        raise ValueError("scores don't fit a long")
    primes = primes_for(reach)

    blocks = kept(clean.mapInArrow(_pack, PACKED))
    found = blocks.mapInArrow(_anchor_rows, ANCHORS)
    n_blocks, n_anchors = blocks.agg(F.count("*"), F.sum(F.length(F.replace(F.hex("anchors"), F.lit("00"), F.lit(""))) / 2)).first()
    slots, groups = math.ceil((n_anchors or 0) / SLOT) or 1, math.ceil(n_blocks / CELL) or 1
    dealt = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    anchors = kept(found.withColumn("slot", F.pmod(F.xxhash64("block", "place"), F.lit(slots)).cast("int")))
    key = ["dims", "slot", "group"]

    def grid(rows: DataFrame, function, schema: str) -> DataFrame:
        """`function` over each cell: a slot's anchors and a group's blocks."""
        spread = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return spread.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(function, schema)

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for a, scores, number, ids, labels in _tiles(left, right, primes):
            same = labels == a["label"]
            if number == a["block"]:
                same[a["place"]] = False
            for j in _first(scores, ids, np.flatnonzero(same), positives):
                out.append((a["block"], a["place"], a["anchor_id"], int(ids[j]), int(scores[j])))
        return _table(out, ["block", "place", "anchor_id", "other_id", "score"])

    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "other_id")
    chosen = grid(anchors, alike, NEAR).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives)
    wanted = chosen.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("k", "other_id", "score"))).alias("positives"))
    asked = kept(anchors.join(wanted, ["block", "place"]))

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for a, scores, _, ids, labels in _tiles(left, right, primes):
            other = np.flatnonzero(labels != a["label"])
            own = 100 * scores[other]
            for p in a["positives"]:
                fits = other[(own >= low * p["score"]) & (own <= high * p["score"])]
                for j in _first(scores, ids, fits, negatives):
                    out.append((a["block"], a["place"], a["anchor_id"], p["k"], p["other_id"], p["score"], int(ids[j]), int(scores[j])))
        return _table(out, ["block", "place", "anchor_id", "k", "positive_id", "positive_score", "negative_id", "negative_score"])

    of_pair = Window.partitionBy("block", "place", "k").orderBy(F.desc("negative_score"), "negative_id")
    found = grid(asked, unlike, "block long, place int, anchor_id long, k long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = found.withColumn("rank", F.row_number().over(of_pair)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}

ORACLE = {
    "op13_hard_negatives": """
with clean as (
  select row_number() over () as row_no, vec_id,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.row_no as a_no, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from clean a join clean b on a.row_no <> b.row_no and len(a.v) = len(b.v)
  where a.vec_id % 100 = 0),
positives as (
  select * from (select *, row_number() over (partition by a_no order by score desc, other_id) as k from scored where same) where k <= 5),
pairs as (
  select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.a_no, p.k order by n.score desc, n.other_id) as rank
  from positives p join scored n on p.a_no = n.a_no and not n.same
   and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from pairs where rank <= 5
"""
}
