"""Keep-first / keep-last windows and id set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given total order. Spark keeps one row per key
    and task before the shuffle (group limit), so a hot key does not travel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn__", F.row_number().over(w)).filter(F.col("rn__") == 1).drop("rn__")


def keep_first_link(df: DataFrame, *order: str, link: str = "link_inmueble") -> DataFrame:
    """Trimmed link, first occurrence in source order."""
    trimmed = df.withColumn(link, F.trim(F.col(link)))
    return keep_one(trimmed, [link], [F.asc(c) for c in order])


def keep_last(df: DataFrame, key: str, *recency: str) -> DataFrame:
    """Most recent row per key."""
    return keep_one(df, [key], [F.desc_nulls_last(c) for c in recency])


def keep_first_array(df: DataFrame, column: str, *order: str) -> DataFrame:
    """First row per array value."""
    return keep_one(df, [column], [F.asc(c) for c in order])


def ordered_unique_union(first: DataFrame, second: DataFrame, value: str = "id", position: str = "pos") -> DataFrame:
    """Both lists in order, each value once, at its first place."""
    both = first.select(value, position, F.lit(0).alias("list_no")).unionByName(
        second.select(value, position, F.lit(1).alias("list_no"))
    )
    return both.groupBy(value).agg(F.min(F.struct("list_no", position)).alias("first__")).select(value, "first__.*")


def union_all(*parts: DataFrame) -> DataFrame:
    """U1"""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reconcile(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly these columns, missing ones NULL of the right type, as are
    values that the type cannot hold."""
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).try_cast(t).alias(c) for c, t in schema]
    )


def union_reconciled(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two snapshots whose columns may differ."""
    return kept.unionByName(new, allowMissingColumns=True)


def ids_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3"""
    return a.unionByName(b).distinct()


def token_difference(a: Column, b: Column) -> Column:
    """U3 on token arrays."""
    return F.array_except(a, b)


def target_ids(listed: DataFrame, stored: DataFrame, mode: str, key: str = "id", text: str = "pref_text") -> DataFrame:
    """U4: ids to fetch. `all` = listed; `new` = not stored; `missing` = new or
    stored with a blank text."""
    ids = listed.select(key).distinct()
    if mode == "all":
        return ids
    known = stored
    if mode == "missing":
        known = stored.filter(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    return ids.join(known.select(key), key, "left_anti")
