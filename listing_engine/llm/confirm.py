"""Links between texts, confirmed on full sets of shingles, out of buckets of candidates.

Nodes that common buckets connect are a family. The nodes of a family meet once,
with all their shingles, in one cell (or one for each two parts of it), where every
candidate pair of two sets is compared; only links leave the cell.

Families of more than FAMILY_PARTS parts are searched bucket by bucket instead: a
cell holds nodes of which some pairs may be linked; a test that needs no
shingles names its candidates. A cell never hands on all its pairs. In a few
rounds each node takes one candidate of another set, these pairs are confirmed,
and sets of linked nodes grow. In the end the untested candidates across two sets
are confirmed: of small cells as pairs; of larger ones only the nodes meet again
in their cells, now with their shingles, and all those pairs are confirmed there.
So no candidate is left untested unless others connect its ends already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_engine.llm.shared import kept, small_side

#: A function (rows, i, j) that says which of the pairs (i, j) are candidates.
Near = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]
#: Nodes of a larger cell that all others are compared with first, those that agree most with the cell as a whole.
CENTRES = 16
#: Untested pairs that a larger cell hands on at most; beyond it its nodes meet again.
CELL_PAIRS = 1 << 18

#: Nodes of a bucket that one cell holds, and members of their sets; larger buckets are cells of two parts.
PART, PART_MEMBERS = 2048, 1 << 19
#: Nodes of a part of a family (and PART_MEMBERS members of their sets); families of more parts are searched by buckets.
FAMILY_PART, FAMILY_PARTS = 1024, 32
#: Cells of up to so many nodes are compared all at once.
SMALL = 16
#: Pairs that are compared at once.
PAIRS = 1 << 17
#: Members of the sets that a tile of pairs holds on one side (about).
TILE_MEMBERS = 1 << 19
#: Pairs of a tile (about).
TILE_PAIRS = 1 << 14
#: Rounds of single pairs before cells meet with all shingles.
ROUNDS = 2
#: Names that may be broadcast.
BROADCAST_ROWS = 1_000_000


def spread(rows: DataFrame) -> DataFrame:
    """name, bucket, cell: rows of buckets with several `parts` go to one cell for each part that theirs meets."""
    own = F.pmod(F.xxhash64("name"), "parts")
    small, large = F.least(own, F.col("other")), F.greatest(own, F.col("other"))
    several = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    return several.select("name", "bucket", (small * F.col("parts") + large).alias("cell"))


def cells_of(dealt: DataFrame, part: int = PART) -> DataFrame:
    """name, bucket, cell of the rows (name, bucket) that share their bucket; none holds more than two parts of about `part` nodes."""
    counts = dealt.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / part).alias("parts"))
    return spread(dealt.join(counts, "bucket"))


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "name")


def _whole_cells(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[dict[str, np.ndarray]]:
    """Columns of runs of whole cells, about `size` bytes at a time; `values` as rows of bytes."""

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        c = batch.column(name)
        if name == "values":
            return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)
        return np.array([*c.to_pylist(), None], object)[:-1] if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)

    held: list[dict[str, np.ndarray]] = []
    weight = 0
    for whole in batches:
        for start in range(0, len(whole), 1024):
            batch = whole.slice(start, 1024)
            held.append({n: column(batch, n) for n in batch.schema.names})
            weight += batch.nbytes
            if weight < size:
                continue
            rows = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            new = np.flatnonzero((np.diff(rows["bucket"]) != 0) | (np.diff(rows["cell"]) != 0)) + 1
            stop = int(new[-1]) if len(new) else 0
            held = [{n: c[stop:] for n, c in rows.items()}]
            if stop:
                weight = batch.nbytes
                yield {n: c[:stop] for n, c in rows.items()}
            else:
                size = max(size, 2 * weight)  # a cell of its own
    if held and len(held[0]["cell"]) + len(held) > 1:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _bounds(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each cell, and the cell's number of each row."""
    new = np.concatenate(([True], (np.diff(rows["bucket"]) != 0) | (np.diff(rows["cell"]) != 0)))
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new))), np.cumsum(new)


def _small_pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of the pairs of two sets in small cells."""
    _, size, group = _bounds(rows)
    few = np.repeat(size <= SMALL, size)
    for step in range(1, min(SMALL, len(group))):
        i = np.flatnonzero((group[step:] == group[:-step]) & few[:-step] & (rows["set"][step:] != rows["set"][:-step]))
        if len(i):
            yield i, i + step


def _large_cells(rows: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Positions of each larger cell that holds several sets, sorted by set."""
    start, size, _ = _bounds(rows)
    for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        own = rows["set"][a : a + n]
        if (own != own[0]).any():
            yield a + np.argsort(own, kind="stable")


def _pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of two sets in each cell, a bounded number at a time."""
    yield from _small_pairs(rows)
    for at in _large_cells(rows):
        block = max(1, PAIRS // len(at))
        sets = rows["set"][at]
        behind = np.searchsorted(sets, sets, side="right")  # the first row of a later set
        for a in range(0, len(at), block):
            b = min(len(at), a + block)
            i, j = np.nonzero(np.arange(len(at)) >= behind[a:b, None])
            if len(i):
                yield at[a + i], at[j]


def _not_tested(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that were no node and its partner in any round."""
    new = np.ones(len(i), bool)
    for partner in (c for n, c in rows.items() if n.startswith("partner")):
        new &= (partner[i] != rows["name"][j]) & (partner[j] != rows["name"][i])
    return i[new], j[new]


def _agreement(values: np.ndarray) -> np.ndarray:
    """How many of its values each row has in common with the most frequent ones."""
    usual = np.array([np.bincount(column, minlength=256).argmax() for column in values.T], np.uint8)
    return np.count_nonzero(values == usual, axis=1)


def _closest(rows: dict[str, np.ndarray], at: np.ndarray, fresh: Callable, first: np.ndarray) -> None:
    """Set `first` of the rows `at` to that candidate among the cell's centres with which most values are equal."""
    values = rows["values"]
    most = np.full(len(first), -1)
    for centre in at[np.argsort(-_agreement(values[at]), kind="stable")[:CENTRES]]:
        other = at[rows["set"][at] != rows["set"][centre]]
        _, found = fresh(rows, np.full(len(other), centre), other)
        equal = np.count_nonzero(values[found] == values[centre], axis=1)
        better = equal > most[found]
        first[found[better]], most[found[better]] = centre, equal[better]


def _partners(near: Near, central: bool = False):
    """A function over cells: pairs (a, b) in which nodes have found one candidate of another set, that
    isn't their partner yet, and how many values are equal. central: larger cells try their centres first."""

    def fresh(rows, i, j):
        return _not_tested(rows, *(x[near(rows, i, j)] for x in (i, j)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            n = len(rows["name"])
            first = np.full(n, n)
            for at in _large_cells(rows):
                if central:
                    _closest(rows, at, fresh, first)
                    at = at[first[at] == n]
                # a node without a candidate so far is compared with all those of other sets behind it
                while len(at) > 1 and rows["set"][at[0]] != rows["set"][at[-1]]:
                    lead, at = at[0], at[1:]
                    other = at[rows["set"][at] != rows["set"][lead]]
                    _, found = fresh(rows, np.full(len(other), lead), other)
                    first[found] = lead
                    at = at[first[at] == n]
            for i, j in _small_pairs(rows):
                i, j = fresh(rows, i, j)
                np.minimum.at(first, j, i)
            own = np.flatnonzero(first < n)
            equal = np.count_nonzero(rows["values"][own] == rows["values"][first[own]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rows["name"][first[own]]), pa.array(rows["name"][own]), pa.array(equal)], names=["a", "b", "equal"])

    return search


def _untested(rows: dict[str, np.ndarray], near: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of two sets that aren't a node and its partner."""
    for i, j in _pairs(rows):
        found = near(rows, i, j)
        yield _not_tested(rows, i[found], j[found])


def _open_nodes(near: Near, central: bool = False):
    """A function over cells: untested candidates of two sets, as pairs (name, others) from small cells, as
    nodes (bucket, cell, name) from larger ones. central: larger cells with few pairs hand on pairs, too."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            open_ = np.zeros(len(rows["name"]), bool)
            _, size, cell = _bounds(rows)
            few = size[cell - 1] <= SMALL
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            found = list(_untested(rows, near)) if central else _untested(rows, near)
            if central:  # so many pairs of a larger cell are fewer than its nodes with all their shingles
                per_cell = np.bincount(np.concatenate([cell[i] for i, _ in found] + [np.zeros(0, np.int64)]), minlength=len(size) + 1)
                few = few | (per_cell[cell] <= CELL_PAIRS)
            for i, j in found:
                own = few[i]
                pairs.append((np.minimum(rows["name"][i[own]], rows["name"][j[own]]), np.maximum(rows["name"][i[own]], rows["name"][j[own]])))
                open_[i[~own]] = open_[j[~own]] = True
            own = np.flatnonzero(open_)
            nodes = [pa.array(rows[c][own]) for c in ("bucket", "cell", "name")] + [pa.nulls(len(own), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(nodes, names=["bucket", "cell", "name", "others"])
            if pairs:
                one, two = (np.concatenate(c) for c in zip(*pairs))
                order = np.lexsort((two, one))
                one, two = one[order], two[order]
                start = np.flatnonzero(np.concatenate((np.ones(min(1, len(one)), bool), one[1:] != one[:-1])))
                others = pa.ListArray.from_arrays(pa.array(np.append(start, len(one)).astype(np.int32)), pa.array(two))
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(start), pa.int64())] * 2, pa.array(one[start]), others], names=["bucket", "cell", "name", "others"])

    return search


def alike(a: bytes, b: bytes, per_cent: int) -> bool:
    """Whether two sets (sorted 64-bit hashes) have per_cent of all their members in common."""
    one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= per_cent * (len(one) + len(two) - both)


def _confirmed(near: Near, per_cent: int):
    """A function over a cell with members: links (a, b) of all untested candidates, without those that others connect already."""

    def confirm(table: pa.Table) -> pa.Table:
        rows = next(_whole_cells(iter(table.combine_chunks().to_batches()), table.nbytes + 1))
        lead: dict[int, int] = {}

        def top(s):
            while lead.setdefault(s, s) != s:
                lead[s] = s = lead[lead[s]]
            return s

        links = []
        for i, j in _untested(rows, near):
            for x, y in zip(i.tolist(), j.tolist()):
                u, v = top(int(rows["set"][x])), top(int(rows["set"][y]))
                if u != v and alike(rows["members"][x], rows["members"][y], per_cent):
                    lead[u] = v
                    links.append((int(rows["name"][x]), int(rows["name"][y])))
        return pa.table([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return confirm


def _joined(rows: dict[str, np.ndarray], at: np.ndarray, near: Near, per_cent: int) -> Iterator[tuple[int, int]]:
    """Positions (i, j) of links that connect all candidates of a larger cell that are linked.

    Each node is compared with the candidates behind it that aren't in its set
    yet, those first that agree most with the cell as a whole.
    """
    members = [np.frombuffer(m, np.uint64) for m in rows["members"][at]]
    n = np.array([len(m) for m in members])
    start = np.cumsum(n) - n
    known, code = np.unique(np.concatenate(members), return_inverse=True)
    own, held = np.arange(len(at)), np.zeros(len(known), np.int64)
    order = np.argsort(-_agreement(rows["values"][at]), kind="stable")
    for k, lead in enumerate(order, 1):
        other = order[k:][own[order[k:]] != own[lead]]
        other = other[near(rows, np.full(len(other), at[lead]), at[other])]
        if not len(other):
            continue
        shift = np.cumsum(n[other]) - n[other]
        place = np.repeat(start[other] - shift, n[other]) + np.arange(n[other].sum())
        mine = code[start[lead] : start[lead] + n[lead]]
        held[mine] = 1
        both = np.add.reduceat(held[code[place]], shift)
        held[mine] = 0
        linked = other[100 * both >= per_cent * (n[lead] + n[other] - both)]
        met, first = np.unique(own[linked], return_index=True)
        yield from ((int(at[lead]), int(at[j])) for j in linked[first])
        own[np.isin(own, met)] = own[lead]


def _linked(near: Near, per_cent: int):
    """A function over cells with members: links (a, b) that connect all candidates of a cell that are linked."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            rows["set"] = np.arange(len(rows["name"]))
            links: list[tuple[int, int]] = []
            for i, j in _small_pairs(rows):
                found = near(rows, i, j)
                pairs = zip(i[found].tolist(), j[found].tolist())
                links += [(x, y) for x, y in pairs if alike(rows["members"][x], rows["members"][y], per_cent)]
            for at in _large_cells(rows):
                links += _joined(rows, at, near, per_cent)
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows["name"][ends[:, k]]) for k in (0, 1)], names=["a", "b"])

    return search


def _families(dealt: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """name, root of the rows (name, bucket) that common buckets connect with others."""
    ends = dealt.groupBy("bucket").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low <> high")
    stars = components(dealt.join(ends, "bucket").select(F.col("name").alias("a"), F.col("low").alias("b")))
    stars = stars.select(F.col("node").alias("name"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("name"), "root").distinct())


def _members(members: DataFrame, names: DataFrame) -> DataFrame:
    """name, members of the distinct `names`."""
    return members.join(small_side(names, BROADCAST_ROWS), "name", "left_semi").groupBy("name").agg(F.first("members").alias("members"))


def _tested(pairs: DataFrame, sets: DataFrame, members: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets; tiles of pairs share the sets of their names."""
    parts = F.lit(max(1, math.ceil(members / TILE_MEMBERS), math.ceil(math.sqrt(pairs.count() / TILE_PAIRS))))
    tile = [F.pmod(F.xxhash64(c), parts).cast("int").alias(f"tile_{c}") for c in ("a", "b")]
    dealt = pairs.select("a", "b", *tile)
    wanted = dealt.select(F.col("tile_a").alias("row"), F.col("tile_b").alias("column"), F.explode(F.array("a", "b")).alias("name")).distinct()

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(left.column("name").to_pylist(), left.column("members")))
        rows = right.select(["a", "b"])
        good = [alike(held[a.as_py()].as_buffer(), held[b.as_py()].as_buffer(), per_cent) for a, b in zip(rows.column("a"), rows.column("b"))]
        return rows.filter(pa.array(good, pa.bool_()))

    held = wanted.join(sets, "name").select("row", "column", "name", "members")
    return held.groupBy("row", "column").cogroup(dealt.groupBy("tile_a", "tile_b")).applyInArrow(test, "a long, b long")


def confirmed_links(
    members: DataFrame,
    dealt: DataFrame,
    nodes: DataFrame,
    near: Near,
    components: Callable[[DataFrame], DataFrame],
    per_cent: int,
    central: bool = False,
    part: int | None = None,
) -> DataFrame:
    """Links (a, b) that connect all nodes of common buckets that are candidates and have per_cent of their members in common.

    members: name, members (sorted hashes) of all texts, read for the names in
    question only. dealt: name, bucket, read several times. nodes: name, n
    (members of its set), values (what `near` compares), read several times.
    components: from links to (node, root). central: for families that are
    searched by buckets, see _partners and _open_nodes. part: instead of FAMILY_PART and PART.
    """
    named = kept(_families(dealt, components).join(nodes.select("name", "n"), "name"))
    parts = F.greatest(F.ceil(F.count("*") / (part or FAMILY_PART)), F.ceil(F.sum("n") / PART_MEMBERS))
    sized = kept(named.join(named.groupBy("root").agg(parts.alias("parts")), "root").select("name", F.col("root").alias("bucket"), "parts"))
    few, many = sized.filter(F.col("parts") <= FAMILY_PARTS), sized.filter(F.col("parts") > FAMILY_PARTS)
    rows = spread(few).join(nodes.select("name", "n", "values"), "name").join(_members(members, few.select("name")), "name")
    links = _in_cells(rows).mapInArrow(_linked(near, per_cent), "a long, b long")
    if many.isEmpty():
        return links
    rest = dealt.join(many.select("name"), "name", "left_semi")
    cells = kept(cells_of(rest, part) if part else cells_of(rest))
    return links.unionByName(_links_by_buckets(members, cells, nodes, near, components, per_cent, central))


def _links_by_buckets(
    members: DataFrame, cells: DataFrame, nodes: DataFrame, near: Near, components: Callable[[DataFrame], DataFrame], per_cent: int, central: bool
) -> DataFrame:
    """confirmed_links() of the nodes in `cells` (name, bucket, cell; read several times), without their families."""
    links = None
    now = nodes.select("name", "n", "values", F.col("name").alias("set"))
    for turn in range(ROUNDS):
        found = _in_cells(cells.join(now, "name")).mapInArrow(_partners(near, central), "a long, b long, equal long")
        pairs = kept(found.groupBy("b").agg((F.max(F.struct("equal", "a"))["a"] if central else F.min("a")).alias("a")))
        if pairs.isEmpty():
            break
        used = kept(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct())
        total = used.join(nodes, "name").agg(F.sum("n")).first()[0] or 0
        new = _tested(pairs, _members(members, used), total, per_cent)
        links = kept(new if links is None else links.unionByName(new))
        roots = components(links).select(F.col("node").alias("name"), "root")
        partners = pairs.select(F.col("b").alias("name"), F.col("a").alias(f"partner{turn}"))
        known = now.drop("set").join(roots, "name", "left").join(partners, "name", "left")
        now = kept(known.withColumns({"set": F.coalesce("root", "name"), f"partner{turn}": F.coalesce(f"partner{turn}", "name")}).drop("root"))
        # cells whose nodes are in one set have no more to say
        several = cells.join(now.select("name", "set"), "name").groupBy("bucket", "cell").agg(F.min("set").alias("low"), F.max("set").alias("high"))
        cells = kept(cells.join(several.filter("low <> high").select("bucket", "cell"), ["bucket", "cell"], "left_semi"))
    if links is None:
        return cells.sparkSession.createDataFrame([], "a long, b long")
    found = kept(_in_cells(cells.join(now, "name")).mapInArrow(_open_nodes(near, central), "bucket long, cell long, name long, others array<long>"))
    joined = found.filter("others is not null").groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    pairs = kept(joined.select(F.col("name").alias("a"), F.explode("others").alias("b")))
    if not pairs.isEmpty():
        used = kept(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct())
        total = used.join(nodes, "name").agg(F.sum("n")).first()[0] or 0
        links = links.unionByName(_tested(pairs, _members(members, used), total, per_cent))
    open_ = found.filter("others is null").select("bucket", "cell", "name")
    if open_.isEmpty():
        return links
    again = open_.join(nodes.select("name", "n"), "name")
    sizes = again.groupBy("bucket", "cell").agg(F.ceil(F.sum("n") / PART_MEMBERS).alias("parts"))
    parted = spread(again.join(sizes, ["bucket", "cell"]).withColumn("bucket", F.xxhash64("bucket", "cell")))
    rows = parted.join(now, "name").join(_members(members, open_.select("name").distinct()), "name")
    return links.unionByName(rows.groupBy("bucket", "cell").applyInArrow(_confirmed(near, per_cent), "a long, b long"))
