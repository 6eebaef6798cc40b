"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by how many documents hold them, rare ones first. An item
bundle (up to PART_ITEMS items over one block of documents) travels from owner
to owner: at each it is cogrouped with that owner's postings of the block, whose
whole-number contributions are added to the sparse accumulators (documents and
sums) that it carries. Between two owners the tenth best sum of each item over
all blocks is a floor of its final tenth score; accumulators that cannot reach
it even with the highest contributions of all later owners are dropped, which
leaves the result exact. The last owner hands on the best documents of each
bundle, from which a window takes the final ones.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listing_engine.llm.shared import kept, shared_folder, small_side, table, text_blocks

#: Bytes that are no part of a term become blanks, A-Z become a-z; bytes of other code points stay.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_TERMS = bytes(b if _TERM.match(bytes([b])) else 32 for b in range(256)).lower()
#: An owner holds the terms of which this share of the documents, or less, has one; the last one holds the rest.
OWNERS = (1 / 256, 1 / 32, 1 / 6)
BEST = 10
#: Documents and postings of a block, items of a bundle.
BLOCK_DOCS, BLOCK_POSTINGS, PART_ITEMS = 4096, 1 << 20, 256
#: Terms that a scan's dictionary may hold (about); more items take further scans.
DICTIONARY = 1_000_000
#: Small tables (a row a term or an item) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Weight of a document's length (per cent of its terms), scale of a contribution, steepness.
LENGTH, SCALE, STEEP = 90, 1_000_000_000, 8

#: kind 0: a block's documents (left: doc_id, right: number of terms, -1 - terms without a doc_id);
#: kind 1: a term's postings (left: places, right: occurrences); kind 2: an item that shares a term with the block (left: its terms).
#: key: term or item, or for kind 0 the documents with a term; total: all terms, or the documents with the term.
PACKED = "block long, kind int, part int, key long, total long, left binary, right binary, peaks array<struct<tf:long,n:long>>"
BUNDLE = "home long, part int, item_id long, terms binary, rest array<long>, docs binary, sums binary, top array<long>"
FOUND = "item_id long, doc_id long, score long"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


class _Block:
    """Documents and postings of a block as they are gathered."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.terms, self.tfs, self.held = array("q"), array("q"), []

    def add(self, doc_id: int | None, words: list[bytes], known: dict[bytes, int]) -> None:
        counts = Counter(map(known.get, words))
        counts.pop(None, None)
        self.ids.append(doc_id or 0)
        self.sizes.append(len(words) if doc_id is not None else -1 - len(words))
        self.terms.extend(counts)
        self.tfs.extend(counts.values())
        self.held.append(len(counts))

    def rows(self, number: int, items: list[tuple[int, np.ndarray]], holders: list[list[int]]) -> pa.Table:
        sizes = np.array(self.sizes, np.int64)
        n = np.where(sizes < 0, -1 - sizes, sizes)
        out = [(0, 0, int((n > 0).sum()), int(n.sum()), np.array(self.ids, np.int64).tobytes(), sizes.tobytes(), None)]
        place = np.repeat(np.arange(len(n)), self.held)
        term, tf = np.frombuffer(self.terms, np.int64), np.frombuffer(self.tfs, np.int64)
        order = np.lexsort((n[place], tf, term))
        term, tf, place = term[order], tf[order], place[order]
        if len(term):
            # the shortest document of each (term, tf) comes first
            peak = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
            cut = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            ends = np.append(cut[1:], len(term))
            of_peak = np.searchsorted(term[peak], term[cut]).tolist() + [len(peak)]
            pairs = [{"tf": a, "n": b} for a, b in zip(tf[peak].tolist(), n[place[peak]].tolist())]
            places, tfs = place.astype(np.uint16), tf.astype(np.int32)
            for i, (t, a, b) in enumerate(zip(term[cut].tolist(), cut.tolist(), ends.tolist())):
                out.append((1, 0, t, b - a, places[a:b].tobytes(), tfs[a:b].tobytes(), pairs[of_peak[i] : of_peak[i + 1]]))
            for i in sorted({i for t in term[cut].tolist() for i in holders[t]}):
                out.append((2, i // PART_ITEMS, items[i][0], None, items[i][1].tobytes(), None, None))
        peaks = pa.list_(pa.struct([("tf", pa.int64()), ("n", pa.int64())]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), peaks)
        columns = [pa.array([number] * len(out), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))]
        return pa.table(columns, names=["block", "kind", "part", "key", "total", "left", "right", "peaks"])


def _packer(items: list[tuple[int, list[bytes]]]):
    """A function that packs documents (doc_id, text) into blocks of PACKED rows; items: (item_id, distinct terms)."""
    known: dict[bytes, int] = {}
    coded = [(item, np.array([known.setdefault(t, len(known)) for t in terms], np.int32)) for item, terms in items]
    holders: list[list[int]] = [[] for _ in known]
    for i, (_, own) in enumerate(coded):
        for t in own.tolist():
            holders[t].append(i)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            at, ids = 0, batch.column("doc_id").to_pylist()
            for texts in text_blocks(batch.column("text"), 1 << 18):
                for doc_id, text in zip(ids[at : at + len(texts)], texts):
                    block.add(doc_id, terms_of(text), known)
                    if len(block.ids) >= BLOCK_DOCS or len(block.terms) >= BLOCK_POSTINGS:
                        yield from block.rows(number, coded, holders).to_batches(1024)
                        number, block = number + 1, _Block()
                at += len(texts)
        if block.ids:
            yield from block.rows(number, coded, holders).to_batches(1024)

    return pack, coded


def _visit(owner: int, last: bool, n_docs: int, n_terms: int):
    """What an owner does with the bundles of a block: left, rows of BUNDLE with `floor`; right, postings with `weight` and the block's documents."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        right = right.to_pylist()
        documents = next((r for r in right if r["kind"] == 0), None)
        if documents is not None and len(left):
            sizes = np.frombuffer(documents["right"], np.int64)
            unnamed = sizes < 0
            m = 100 - LENGTH + (LENGTH * np.where(unnamed, -1 - sizes, sizes) * n_docs) // max(1, n_terms)
            postings = {}
            for r in right:
                if r["kind"] == 1:
                    place, tf = np.frombuffer(r["left"], np.uint16), np.frombuffer(r["right"], np.int32).astype(np.int64)
                    postings[r["key"]] = place, r["weight"] * ((SCALE * tf) // (1000 * tf + STEEP * m[place]))
            ids = np.frombuffer(documents["left"], np.int64)
            for r in left.to_pylist():
                sums = np.zeros(len(sizes), np.int64)
                if r["docs"]:
                    sums[np.frombuffer(r["docs"], np.uint16)] = np.frombuffer(r["sums"], np.int64)
                for t in np.frombuffer(r["terms"], np.int32).tolist():
                    if t in postings:
                        place, share = postings[t]
                        sums[place] += share
                later = sum(r["rest"][owner + 1 :])
                docs = np.flatnonzero((sums > 0) & (sums + later >= r["floor"]) & ~unnamed)
                if last:
                    docs = docs[np.lexsort((ids[docs], -sums[docs]))[:BEST]]
                    out += zip([r["item_id"]] * len(docs), ids[docs].tolist(), sums[docs].tolist())
                elif len(docs) or later >= max(1, r["floor"]):
                    own = sums[docs]
                    top = np.sort(np.partition(own, len(own) - BEST)[-BEST:] if len(own) > BEST else own)
                    out.append((r["home"], r["part"], r["item_id"], r["terms"], r["rest"], docs.astype(np.uint16).tobytes(), own.tobytes(), top.tolist()))
        if last:
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["item_id", "doc_id", "score"])
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=["home", "part", "item_id", "terms", "rest", "docs", "sums", "top"])

    return visit


def _ranked(docs: DataFrame, items: list[tuple[int, list[bytes]]]) -> DataFrame:
    """The BEST documents of each of `items` (item_id, distinct terms)."""
    spark = docs.sparkSession
    pack, coded = _packer(items)
    packed = kept(docs.select("doc_id", "text").mapInArrow(pack, PACKED))
    n_docs, n_terms = (int(x or 0) for x in packed.filter("kind = 0").agg(F.sum("key"), F.sum("total")).first())
    size = f"({100 - LENGTH} + ({LENGTH} * p.n * {n_docs}L) div {max(1, n_terms)}L)"
    peak = F.array_max(F.expr(f"transform(peaks, p -> ({SCALE}L * p.tf) div (1000 * p.tf + {STEEP} * {size}))"))
    owner = F.lit(len(OWNERS))
    for i, share in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("df") <= share * n_docs, F.lit(i)).otherwise(owner)
    terms = packed.filter("kind = 1").groupBy(F.col("key").alias("term")).agg(F.sum("total").alias("df"), F.max(peak).alias("peak"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    terms = kept(terms.withColumn("weight", weight.cast("long")).withColumn("owner", owner))

    names = {i: [] for i in range(len(OWNERS) + 1)}
    used = spark.createDataFrame([(i, t) for i, own in coded for t in own.tolist()], "item_id long, term long").join(terms, "term")
    rest = used.groupBy("item_id").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("owner") == i, F.col("weight") * F.col("peak"))), F.lit(0).cast("long")) for i in names)).alias("rest"))
    n_parts = math.ceil(len(items) / PART_ITEMS)
    bundles = packed.filter("kind = 2").select(F.col("block").alias("home"), "part", F.col("key").alias("item_id"), F.col("left").alias("terms"))
    bundles = bundles.join(small_side(rest, BROADCAST_ROWS), "item_id").select(
        "home", "part", "item_id", "terms", "rest", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("sums"), F.array().cast("array<long>").alias("top")
    )
    every_part = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))
    documents = packed.filter("kind = 0").select("block", "kind", "key", "left", "right", F.lit(0).cast("long").alias("weight"))
    floors = None
    for i in names:
        last = i == len(OWNERS)
        weights = small_side(terms.filter(F.col("owner") == i).select(F.col("term").alias("key"), "weight"), BROADCAST_ROWS)
        postings = packed.filter("kind = 1").select("block", "kind", "key", "left", "right").join(weights, "key")
        owned = postings.select(*documents.columns).unionByName(documents).withColumn("part", every_part)
        asked = bundles.withColumn("floor", F.lit(0).cast("long"))
        if floors is not None:
            asked = bundles.join(small_side(floors, BROADCAST_ROWS), "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
        visited = asked.groupBy("home", "part").cogroup(owned.groupBy("block", "part")).applyInArrow(_visit(i, last, n_docs, n_terms), FOUND if last else BUNDLE)
        if last:
            return visited
        bundles = kept(visited)
        highest = Window.partitionBy("item_id").orderBy(F.desc("sum"))
        sums = bundles.select("item_id", F.explode("top").alias("sum")).withColumn("k", F.row_number().over(highest))
        floors = kept(sums.filter(F.col("k") <= BEST).groupBy("item_id").agg(F.min("sum").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == BEST).select("item_id", "floor"))


def lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the 10 best documents (doc_id, text) of each item (item_id, text) with a score above 0.

    Terms are runs of letters, digits and code points from U+0080, A-Z
    lower-cased; see the module for the order of work. Equal scores by ascending
    doc_id. Null and empty texts have no term. Rows without a doc_id count in all
    statistics but aren't listed; rows without an item_id are left out; rows of
    one item_id are one item with the terms of all; repeated document rows are
    documents of their own. Very long texts are read whole, one at a time. An
    empty table gives no row; further columns are ignored.
    """
    spark = docs.sparkSession
    named = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    length = named.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = math.ceil(length / (6 * DICTIONARY)) or 1
    path = None
    for i in range(slices):
        texts: dict[int, list[str]] = {}
        for r in named.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).toLocalIterator():
            texts.setdefault(r["item_id"], []).append(r["text"])
        own = [(item, sorted({t for text in some for t in terms_of(text)})) for item, some in sorted(texts.items())]
        own = [(item, terms) for item, terms in own if terms]
        if not own:
            continue
        found = _ranked(docs, own)
        if slices == 1:
            path = found
        else:  # a scan for each slice of the items
            path = path or shared_folder(spark, "lexical-search")
            found.write.mode("append").parquet(path)
    if path is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = path if isinstance(path, DataFrame) else spark.read.parquet(path)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= BEST).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_lexical_search": op11_lexical_search}

ORACLE = {
    "op11_lexical_search": r"""
with words as (
  select row_number() over () as row_no, doc_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents where text is not null),
item_terms as (
  select distinct item_id, term from (
    select item_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where text is not null and item_id is not null) where term <> ''),
totals as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from words where len(w) > 0),
postings as (select row_no, doc_id, len(w) as n, unnest(w) as term from words),
tfs as (select row_no, doc_id, n, term, count(*) as tf from postings where term in (select term from item_terms) group by all),
dfs as (select term, count(*) as df from tfs group by term),
weights as (select term, cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1))) as bigint) as w from dfs, totals),
scores as (
  select i.item_id, t.row_no, t.doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) as bigint) as score
  from item_terms i join tfs t on i.term = t.term join weights v on v.term = t.term, totals
  group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0 and doc_id is not null)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
}
