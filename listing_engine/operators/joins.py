"""Lookups, deltas and coverage joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_ids(today: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Listed today, not stored yet."""
    return today.join(stored.select(key), key, "left_anti")


def still_listed(stored: DataFrame, today: DataFrame, key: str) -> DataFrame:
    """Stored rows that are listed today."""
    return stored.join(today.select(key), key, "left_semi")


def new_by_first_key(current: DataFrame, previous: DataFrame, candidates: tuple[str, ...] = ("reference", "url")) -> DataFrame:
    """J3 on the first of the candidate keys the current table has."""
    key = next(c for c in candidates if c in current.columns)
    if key not in previous.columns:
        return current
    return new_ids(current, previous, key)


def unmatched_clients(clients: DataFrame, matches: DataFrame) -> DataFrame:
    """J8"""
    return clients.join(matches.select("client_id"), "client_id", "left_anti")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, target: str, default: Column | None = None) -> DataFrame:
    """Left join of a (key, value) dictionary. No broadcast hint: Spark
    broadcasts the dictionary when its measured size allows it."""
    d = dim.select(F.col(key).alias("key__"), F.col(value).alias("value__"))
    out = F.col("value__") if default is None else F.coalesce("value__", default)
    return df.join(d, F.col(target) == F.col("key__"), "left").withColumn(target, out).drop("key__", "value__")


def client_operation(matches: DataFrame, clients: DataFrame) -> DataFrame:
    """The operation each matched client asked for."""
    ops = clients.select("client_id", F.col("operation").alias("client_operation"))
    return matches.join(ops, "client_id", "left")


def with_preference_text(base: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """J10: '' where no text is known."""
    joined = base.join(texts.select(key, "pref_text"), key, "left")
    return joined.withColumn("pref_text", F.coalesce("pref_text", F.lit("")))


def zone_coverage(a: DataFrame, b: DataFrame, c: DataFrame, zone: str = "zona_std") -> DataFrame:
    """Full outer coverage of three sources on the zone, NULL matching NULL.

    Each source is reduced to one row per zone first; `joined_rows` is the
    number of rows the row-level outer join would have, without producing them.
    """
    def counted(df: DataFrame, n: int) -> DataFrame:
        return df.groupBy(F.col(zone).alias(f"zone{n}")).agg(F.count(F.lit(1)).alias(f"rows_{n}"))

    one, two, three = counted(a, 1), counted(b, 2), counted(c, 3)
    ab = one.join(two, F.col("zone1").eqNullSafe(F.col("zone2")), "full").select(
        F.when(F.col("rows_1").isNotNull(), F.col("zone1")).otherwise(F.col("zone2")).alias("zone12"), "rows_1", "rows_2"
    )
    in_ab = F.coalesce("rows_1", "rows_2").isNotNull()
    n = lambda k: F.coalesce(F.col(f"rows_{k}"), F.lit(0))
    return ab.join(three, F.col("zone12").eqNullSafe(F.col("zone3")), "full").select(
        F.when(in_ab, F.col("zone12")).otherwise(F.col("zone3")).alias("zone"),
        n(1).alias("rows_1"),
        n(2).alias("rows_2"),
        n(3).alias("rows_3"),
        (F.greatest(n(1), F.lit(1)) * F.greatest(n(2), F.lit(1)) * F.greatest(n(3), F.lit(1))).alias("joined_rows"),
    )


# Lengths of the tail by which a contained URL is looked up.
TAILS = (1, 2, 4, 8, 16, 32)


def _containment(short: DataFrame, long: DataFrame, short_url: str, long_url: str) -> DataFrame:
    """All (short, long) rows whose long URL contains the short one.

    Blocked on the tail of the short URL: its last k characters (k the largest
    power of two that fits, at most 32) must occur in the long URL, so the long
    side is exploded into its windows of that length and joined by equality.
    The tail holds the listing's number, which keeps the groups small; the full
    containment test is the residual.
    """
    size = F.length(short_url)
    k = F.lit(TAILS[0])
    for t in TAILS[1:]:
        k = F.when(size >= t, t).otherwise(k)
    keyed = short.filter(size > 0).withColumn("tail__", F.substring(F.col(short_url), -k, k))
    used = keyed.agg(F.sort_array(F.collect_set(k))).scalar()
    # one sliding-window row per (k, offset); k takes at most six values
    windows = (
        long.withColumn("k__", F.explode(used))
        .filter(F.length(long_url) >= F.col("k__"))
        .withColumn("at__", F.explode(F.sequence(F.lit(1), F.length(long_url) - F.col("k__") + 1)))
        .withColumn("tail__", F.substring(F.col(long_url), F.col("at__"), F.col("k__")))
        .select(*long.columns, "tail__")
        .distinct()
    )
    return keyed.join(windows, "tail__").filter(F.col(long_url).contains(F.col(short_url))).drop("tail__")


def listing_match_counts(listings: DataFrame, matches: DataFrame, order: str = "match_no") -> DataFrame:
    """Match counts per listing by id, else by the first match (in `order`)
    whose URL equals, contains or is contained in the listing's URL.

    listings: id, link_inmueble; matches: property_id, link_inmueble, score and
    a match order.
    """
    counts = matches.groupBy(F.col("property_id").cast("string").alias("property_id")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= 0.8).alias("high_quality")
    )
    url = lambda c: F.lower(F.trim(c))
    by_id = listings.join(counts, F.col("id").cast("string") == F.col("property_id"), "left")
    resolved = by_id.select("id", "total", "high_quality")
    open_urls = (
        by_id.filter(F.col("total").isNull() & (F.length("link_inmueble") > 0))
        .select(url(F.col("link_inmueble")).alias("own_url"))
        .distinct()
    )
    hits = (
        matches.filter(F.length("link_inmueble") > 0)
        .groupBy(url(F.col("link_inmueble")).alias("match_url"))
        .agg(F.min(F.struct(F.col(order).alias("o"), F.col("property_id").cast("string").alias("p"))).alias("first__"))
    )
    pairs = _containment(open_urls, hits, "own_url", "match_url").unionByName(
        _containment(hits, open_urls, "match_url", "own_url")
    )
    by_url = (
        pairs.groupBy("own_url")
        .agg(F.min("first__").alias("first__"))
        .join(counts.withColumnRenamed("property_id", "pid__"), F.col("first__.p") == F.col("pid__"))
        .select("own_url", F.col("total").alias("t__"), F.col("high_quality").alias("h__"))
    )
    out = listings.join(resolved, "id", "left").join(
        by_url, url(F.col("link_inmueble")) == F.col("own_url"), "left"
    )
    return out.select(
        *listings.columns,
        F.coalesce("total", "t__", F.lit(0)).alias("total"),
        F.coalesce("high_quality", "h__", F.lit(0)).alias("high_quality"),
    )
