"""Daily increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_engine.operators.dedupe import keep_last, reconcile, target_ids, union_reconciled
from listing_engine.operators.joins import new_ids, still_listed, with_preference_text
from listing_engine.sources.files import write_counted

CONTACT_COLUMNS = (
    ("id", "string"),
    ("nombre", "string"),
    ("telefono", "string"),
    ("mail", "string"),
    ("fecha_inclusion", "date"),
    ("creado_info", "string"),
    ("pref_text", "string"),
)


def refresh_snapshot(
    previous: DataFrame, ids_today: DataFrame, parsed_new: DataFrame, key: str = "id_inmueble"
) -> tuple[DataFrame, DataFrame]:
    """(ids to parse, today's table).

    Stored rows survive while still listed, delisted rows drop, parsed new rows
    are added, and the new row wins where both hold an id. `ids_today` has one
    row per listed id.
    """
    fresh_ids = new_ids(ids_today, previous, key)
    kept = still_listed(previous, ids_today, key).withColumn("fresh__", F.lit(0))
    added = parsed_new.withColumn("fresh__", F.lit(1))
    both = union_reconciled(kept, added)
    ties = [c for c in previous.columns if c != key and c in both.columns]
    return fresh_ids, keep_last(both, key, "fresh__", *ties).drop("fresh__")


def latest_before(snapshots: DataFrame, day: str, column: str = "snapshot_date") -> DataFrame:
    """The latest stored snapshot before `day` ("yesterday" of the run).

    The date is a scalar subquery over the partition column, so only that
    partition is read."""
    last = snapshots.filter(F.col(column) < F.to_date(F.lit(day))).agg(F.max(column)).scalar()
    return snapshots.filter(F.col(column) == last)


def latest_base(pages: DataFrame, key: str = "id", *recency: str) -> DataFrame:
    """Base facts per contact, the last page seen wins."""
    return keep_last(pages.filter(F.length(F.trim(F.col(key))) > 0), key, *recency)


def contact_rows(ids: DataFrame, base: DataFrame, texts: DataFrame, today: str) -> DataFrame:
    """One output row per id, defaults where base or text is unknown."""
    joined = ids.select("id").join(base, "id", "left")
    joined = joined.withColumn("fecha_inclusion", F.coalesce("fecha_inclusion", F.to_date(F.lit(today))))
    return reconcile(with_preference_text(joined, texts), CONTACT_COLUMNS)


def upsert_contacts(
    previous: DataFrame, listed: DataFrame, base: DataFrame, texts: DataFrame, mode: str, today: str
) -> DataFrame:
    """`all` replaces the table by today's rows; `missing` and `new` update
    the targeted ids, append unknown ones and keep everybody else."""
    targets = target_ids(listed, previous, mode)
    rows = contact_rows(targets, base, texts, today)
    if mode == "all":
        return rows
    kept = reconcile(previous, CONTACT_COLUMNS).join(targets, "id", "left_anti")
    return kept.unionByName(rows)


def store_snapshot(fresh_ids: DataFrame, today: DataFrame, folder: str) -> DataFrame:
    """Writes both results of refresh_snapshot and reports new_rows and today_rows.

    The counts are observed while the tables are written, so neither is computed or read twice.
    """
    new_rows = write_counted(fresh_ids, f"{folder}/new")
    today_rows = write_counted(today, f"{folder}/today")
    return today.sparkSession.createDataFrame([(new_rows, today_rows)], "new_rows bigint, today_rows bigint")
