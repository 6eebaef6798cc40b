"""MinHash near-duplicates with sequential Bayesian verification.

Texts are sets of distinct shingles; equal sets are one node. Bands of MinHash
rows give buckets of candidates, so many that a pair at the asked similarity is
in none of them only with a chosen chance. Candidates are compared by further
MinHash values, a batch at a time: a pair goes as soon as the posterior (uniform
prior) that its similarity is high enough falls to the chosen chance. What is
left is confirmed on the full sets of shingles (see confirm.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.llm import sets
from listing_engine.llm.confirm import Near, confirmed_links
from listing_engine.llm.near_duplicates import components
from listing_engine.llm.shared import kept, table

WORDS = 2
#: Share of common shingles in per cent of all, and the chance to miss a link: by the bands, and by each posterior test.
PER_CENT = 80
MISS = 1e-6
PRUNE = 1e-5
#: MinHash rows of a band; further values to compare, and of these in a batch.
ROWS, VALUES, BATCH = 5, 128, 32
SIGNED = "doc_id long, name long, n long, keys array<long>, values binary"


def bands_for(per_cent: int = PER_CENT, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the similarity shares none of them with a chance of `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (per_cent / 100) ** rows))


def least_equal(per_cent: int = PER_CENT, prune: float = PRUNE) -> list[int]:
    """For each batch the least number of equal values so far for which a pair stays.

    With a uniform prior the chance of a similarity of s or more, after k of m
    values were equal, is that of at most k hits in m + 1 throws at s.
    """
    s, least = per_cent / 100, []
    for m in range(BATCH, VALUES + 1, BATCH):
        chance = np.cumsum([math.comb(m + 1, k) * s**k * (1 - s) ** (m + 1 - k) for k in range(m + 1)])
        least.append(int(np.searchsorted(chance, prune, side="right")))
    return least


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    return sets.shingle_sets(texts, WORDS)


def signatures(members: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets x bands keys, sets x VALUES bytes)."""
    return sets.signatures(members, bands, ROWS, VALUES)


def _signed(bands: int):
    """From rows (doc_id, text): name and size of the set of shingles, keys of its bands, values to compare; no word: size 0, the rest null."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sets.text_parts(batches):
            found = shingle_sets(texts)
            full = [s for s in found if len(s)]
            own = iter(zip(*signatures(full, bands)) if full else ())
            keys, values = zip(*(next(own) if len(s) else (None, None) for s in found))
            columns = [
                rows.column("doc_id"),
                pa.array([sets.set_name(s) if len(s) else None for s in found], pa.int64()),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array([None if v is None else v.tobytes() for v in values], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "name", "n", "keys", "values"])

    return signed


def surviving(per_cent: int = PER_CENT, prune: float = PRUNE) -> Near:
    """Which of the pairs (i, j) are left when sizes and all batches of values have been looked at."""
    least = least_equal(per_cent, prune)

    def near(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sizes, values = rows["n"], rows["values"]
        left = np.flatnonzero(100 * np.minimum(sizes[i], sizes[j]) >= per_cent * np.maximum(sizes[i], sizes[j]))
        equal = np.zeros(len(left), np.int64)
        for k, enough in enumerate(least):
            at = slice(k * BATCH, (k + 1) * BATCH)
            equal += np.count_nonzero(values[i[left], at] == values[j[left], at], axis=1)
            good = equal >= enough
            left, equal = left[good], equal[good]
        return left

    return near


def minhash_duplicates(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`.

    Texts are linked if per_cent of all distinct two-word shingles of both are
    common (fewer words: the whole text is one shingle); component_id is the
    smallest doc_id reached. Null texts and texts without a word have no shingle
    and keep their own doc_id. Repeated rows stay; rows of one doc_id with
    different texts are judged by their texts; null doc_ids come after all
    others and name no component that has another id; very long texts are taken
    whole, one at a time; an empty table gives no row; further columns are
    ignored. Equal texts always link; a pair at the limit is missed with a chance
    of MISS by the bands and about PRUNE by each of the posterior tests. Sets are
    named and compared by 64-bit hashes.
    """
    named = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signed(bands_for(per_cent)), SIGNED))
    last = (1 << 63) - 1
    nodes = kept(
        named.filter("name is not null")
        .groupBy("name")
        .agg(F.coalesce(F.min("doc_id"), F.lit(last)).alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("values").alias("values"))
    )
    dealt = nodes.select("name", F.explode("keys").alias("bucket"))
    links = confirmed_links(sets.members_of(docs, WORDS), dealt, nodes.select("name", "n", "values"), surviving(per_cent), components, per_cent, central=True)

    # a component is named by its smallest (id, name), so no further look-up of its members is needed
    ids = nodes.select("name", F.struct("id", "name").alias("node"))
    ends = links.join(ids.select(F.col("name").alias("a"), F.col("node").alias("x")), "a").join(ids.select(F.col("name").alias("b"), F.col("node").alias("y")), "b")
    roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = roots.select(F.col("node.name").alias("name"), F.col("root.id").alias("root_id"))
    found = named.select("doc_id", "name", "n").join(ids.join(roots, "name", "left").select("name", F.coalesce("root_id", "node.id").alias("id")), "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.nullif("id", F.lit(last)))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op12_minhash": op12_minhash}

ORACLE = {
    "op12_minhash": r"""
with recursive words as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as materialized (
  select doc_id, case len(w) when 0 then [] when 1 then [w[1]]
         else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words),
members as materialized (select doc_id, len(s) as n, unnest(s) as m from sets),
links as materialized (
  select a.doc_id as a, b.doc_id as b from members a join members b on a.m = b.m
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (
  select a as doc_id, a as other from links
  union
  select r.doc_id, l.b from reach r join links l on r.other = l.a),
least_id as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(component_id, s.doc_id) as component_id, coalesce(component_id, s.doc_id) = s.doc_id as kept
from sets s left join least_id using (doc_id)
"""
}
