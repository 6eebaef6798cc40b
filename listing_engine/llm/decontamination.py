"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask names the words of a window that are hashed; the words between them are
ignored, so a window still hits where one of those was replaced. Hits of
documents and benchmark items on the same seed give an alignment (item and
diagonal); hits that lie close together on it form an island, and all aligned
words of document and item are compared one by one for the best run there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listing_engine.llm.shared import kept, small_side, table

#: 1 marks a word that counts. Where at least 0.8 of 7 words or more
#: agree, four agree in a row, or else runs of three with one word between them
#: (7, 11 and 15 words) or the masks of SHORT fit.
MASKS = ("1111", "1110111")
#: Further masks for whole items of so many words.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("11011", "11101", "10111"), 6: ("111011", "110111"), 10: ("111011",)}
#: Hits of one diagonal that lie further apart are different islands.
GAP = 11
SIMILARITY = 0.8
#: Words that an overlap needs, unless the whole item is shorter.
WORDS = 13
#: Seeds of benchmark items that may be broadcast; more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeds(texts: DataFrame, keys: list[str], short: Iterable[int] | None = None) -> DataFrame:
    """keys, place (word number), span, seed for each window and mask; texts has keys and `words`.

    The masks of SHORT are laid over all texts for the numbers of words in
    `short`, or, without it, over texts of just as many words.
    """
    hashed = texts.filter(F.size("words") > 0).select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    placed = hashed.select(*keys, "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("place"))

    def seed(mask: str, also: Column) -> Column:
        counted = F.xxhash64(F.lit(mask), *(F.get("h", F.col("place") + i) for i, sign in enumerate(mask) if sign == "1"))
        return F.when((F.col("place") + len(mask) <= F.size("h")) & also, F.struct(F.lit(len(mask)).alias("span"), counted.alias("seed")))

    per_mask = [seed(m, F.lit(True)) for m in MASKS]
    if short is None:
        per_mask += [seed(m, F.size("h") == n) for n, masks in SHORT.items() for m in masks]
    else:
        per_mask += [seed(m, F.lit(True)) for m in dict.fromkeys(m for n in sorted(short) for m in SHORT[n])]
    found = placed.select(*keys, "place", F.explode(F.array(*per_mask)).alias("s")).filter("s is not null")
    return found.select(*keys, "place", "s.span", "s.seed")


def best_run(same: Column, first: Column, end: Column, least: Column, similarity: float) -> Column:
    """(first, end) of the run of `same` with the best sum, that has `least` words or more and meets first .. end.

    An equal word adds 1 - similarity to the sum and another one takes
    `similarity` off, so a sum of 0 or more is a share of `similarity`. A run
    ends at each word in turn; the least sum in front of it, `least` words back,
    is carried along. No run of that length: both are 0.
    """
    off = round(1000 * similarity)
    score = lambda i: F.when(F.get(same, i), F.lit(1000 - off)).otherwise(F.lit(-off)).cast("long")
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("back"), none.alias("low"), F.lit(0).alias("low_at"), none.alias("best"), F.lit(0).alias("first"), F.lit(0).alias("end"))

    def step(now: Column, j: Column) -> Column:
        """`now` after the word j - 1; back: the sum in front of word j - least."""
        total, at = now["sum"] + score(j - 1), j - least
        back = F.when(at > 0, now["back"] + score(at - 1)).otherwise(now["back"])
        lower = (at >= 0) & (at < end) & (now["low"].isNull() | (back <= now["low"]))
        low, low_at = F.when(lower, back).otherwise(now["low"]), F.when(lower, at).otherwise(now["low_at"])
        better = (j > first) & low.isNotNull() & (now["best"].isNull() | (total - low > now["best"]))
        return F.struct(
            total.alias("sum"),
            back.alias("back"),
            low.alias("low"),
            low_at.alias("low_at"),
            F.when(better, total - low).otherwise(now["best"]).alias("best"),
            F.when(better, low_at).otherwise(now["first"]).alias("first"),
            F.when(better, j).otherwise(now["end"]).alias("end"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.size(same)), start, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_equal: verified overlaps (words from 0).

    An overlap is the whole item laid over the document, or else the best run of
    words on the diagonal that meets an island of hits (see best_run); a share of
    `similarity` of its words is equal and it has `words` words or is the whole
    item. At 0.8 every overlap has a seed, and items of one word and more match;
    null and empty texts have no words. Repeated rows of equal
    doc_id and text give one result, rows of one doc_id with different texts
    are compared each by itself. Further columns are ignored.
    """
    items = kept(benchmark.filter("text is not null and item_id is not null").select("item_id", words_of(F.col("text")).alias("item_words")).distinct())
    wanted = seeds(items.withColumnRenamed("item_words", "words"), ["item_id"]).select("item_id", F.col("place").alias("item_place"), "seed").distinct()
    short = [r[0] for r in items.select(F.size("item_words").alias("n")).filter(F.col("n").isin(list(SHORT))).distinct().collect()]
    texts = docs.filter("text is not null and doc_id is not null").select("doc_id", "text")
    key = ["doc_id", "text_hash"]
    found = seeds(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")), key, short)
    hits = found.join(small_side(wanted, BROADCAST_SEEDS), "seed")
    alignment = [*key, "item_id", "diagonal"]
    hits = hits.select(*key, "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"), "place", "span").groupBy(*alignment, "place").agg(F.max("span").alias("span"))
    # an alignment has at most as many hits as its item has windows
    along = Window.partitionBy(*alignment).orderBy("place")
    apart = F.col("place") - F.lag("place").over(along) > GAP
    islands = (
        hits.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("island", F.sum("new").over(along))
        .groupBy(*alignment, "island")
        .agg(F.min("place").alias("first"), F.max(F.col("place") + F.col("span")).alias("end"))
    )
    per_doc = islands.groupBy(*key).agg(F.collect_list(F.struct("item_id", "diagonal", "first", "end")).alias("islands"))
    texts = texts.withColumn("text_hash", F.xxhash64("text")).join(per_doc, key).dropDuplicates(key)
    laid = texts.select("doc_id", words_of(F.col("text")).alias("doc_words"), F.explode("islands").alias("i")).select("doc_id", "doc_words", "i.*")
    both = laid.join(items, "item_id")

    whole_first = F.greatest(F.lit(0), F.col("diagonal"))
    whole_end = F.least(F.size("doc_words"), F.col("diagonal") + F.size("item_words"))
    own = F.slice("doc_words", whole_first + 1, whole_end - whole_first)
    other = F.slice("item_words", whole_first - F.col("diagonal") + 1, whole_end - whole_first)
    least = F.least(F.lit(words), F.size("item_words"))
    both = both.withColumn("same", F.zip_with(own, other, lambda a, b: a == b))
    n_equal = F.size(F.filter("same", lambda same: same))
    both = both.withColumn("whole", F.struct(whole_first.alias("first"), whole_end.alias("end"), n_equal.alias("n_equal")))
    # a run can't have more equal words than all
    both = both.filter(F.col("whole.n_equal") >= similarity * least)
    run = best_run(F.col("same"), F.col("first") - F.col("whole.first"), F.col("end") - F.col("whole.first"), least, similarity)
    both = both.withColumn("run", run)
    part_equal = F.size(F.filter(F.slice("same", F.col("run.first") + 1, F.col("run.end") - F.col("run.first")), lambda same: same))
    both = both.withColumn("part", F.struct((F.col("run.first") + F.col("whole.first")).alias("first"), (F.col("run.end") + F.col("whole.first")).alias("end"), part_equal.alias("n_equal")))

    def passes(c: str) -> Column:
        n = F.col(f"{c}.end") - F.col(f"{c}.first")
        return (F.col(f"{c}.n_equal") >= similarity * n) & (n >= least)

    chosen = F.when(passes("whole"), F.col("whole")).when(passes("part"), F.col("part"))
    return (
        both.select("doc_id", "item_id", "diagonal", chosen.alias("o"))
        .filter("o is not null")
        .select(
            "doc_id",
            "item_id",
            F.col("o.first").cast("long").alias("doc_word"),
            (F.col("o.first") - F.col("diagonal")).cast("long").alias("item_word"),
            (F.col("o.end") - F.col("o.first")).cast("long").alias("n_words"),
            F.col("o.n_equal").cast("long").alias("n_equal"),
        )
        .distinct()
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows whose text holds an overlap.

    Rows that share a doc_id are each judged by their own text; rows without a
    doc_id, null and empty texts stay.
    """
    texts = docs.filter("doc_id is not null").select(F.xxhash64("text").alias("doc_id"), "text")
    found = overlaps(texts, benchmark).select(F.col("doc_id").alias("text_hash")).distinct()
    where = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # clear of clashing names
    own = docs.select(*(F.col(c).alias(v) for c, v in where.items()))
    own = own.withColumn("text_hash", F.when(F.col(where["doc_id"]).isNotNull(), F.xxhash64(where["text"])))
    return own.join(found, "text_hash", "left_anti").select(*(F.col(v).alias(c) for c, v in where.items()))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE: dict[str, str] = {}
