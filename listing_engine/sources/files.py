"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from listing_engine import schemas
from listing_engine.functions import text as X
from listing_engine.operators.dedupe import reconcile
from listing_engine.operators.filters import complete_rows, quality_gate
from listing_engine.operators.shaping import derive_operation

BOM = "﻿"


#: Encodings in the order in which they are tried; every byte string is valid in the last one.
ENCODINGS = ("UTF-8", "ISO-8859-1")


def encodings_of(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding: UTF-8 where every line of the file is valid in it, else ISO-8859-1.

    The lines are checked as raw bytes on the executors, split as any text; a
    file is decided by one grouped minimum.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy("file").agg(F.when(F.min("valid"), ENCODINGS[0]).otherwise(ENCODINGS[1]).alias("encoding"))


def read_text_csv(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """Header CSV with every column as text, a leading byte-order mark
    dropped from the first name.

    Without `encoding` each file is read in the first of ENCODINGS in which all
    its bytes are valid, so a folder may mix them; the names of its files come to
    the driver, as in any listing. `multi_line` allows line breaks within quotes
    and reads a file in one task; without it files are split.
    """

    def read(paths: str | list[str], code: str) -> DataFrame:
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("inferSchema", False)
        df = reader.option("encoding", code).csv(paths)
        return df.toDF(*[c.replace(BOM, "").strip() for c in df.columns])

    if encoding is not None:
        return read(path, encoding)
    files: dict[str, list[str]] = {}
    for file, code in encodings_of(spark, path).collect():
        files.setdefault(code, []).append(file)
    if not files:
        return read(path, ENCODINGS[0])
    parts = [read(sorted(files[code]), code) for code in ENCODINGS if code in files]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_portal_csv(spark: SparkSession, path: str, source: str, encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """One portal's listings in their typed schema; a column the file lacks
    is NULL, one it has beyond the schema is dropped."""
    raw = read_text_csv(spark, path, encoding, multi_line)
    raw = raw.withColumnsRenamed({"baños": "banos"})
    kind = {c: t for t, cols in schemas.TYPES.items() for c in cols}
    names = schemas.SOURCES[source]
    text = reconcile(raw, [(c, "string") for c in names])
    cast = lambda c: {
        "int": lambda x: X.to_int(x),
        "double": lambda x: X.to_float(x),
        "boolean": lambda x: x.try_cast("boolean"),
        "date": lambda x: X.iso_day(x),
    }.get(kind.get(c, ""), lambda x: x)(F.col(c))
    return text.select(*[cast(c).alias(c) for c in names])


def _by_name(df: DataFrame, aliases: dict[str, tuple[str, ...]], partial: bool) -> dict[str, Column]:
    """Columns of `df` by canonical name: whole header names, the last one
    wins, or header fragments, the first one wins."""
    found: dict[str, Column] = {}
    for name, accepted in aliases.items():
        if partial:
            hits = [c for c in df.columns if any(a in c.lower() for a in accepted)][:1]
        else:
            hits = [c for c in df.columns if c.lower() in accepted][-1:]
        if hits:
            found[name] = F.col(f"`{hits[0]}`").cast("string")
    return found


def unified_listings(df: DataFrame, today: str) -> DataFrame:
    """S3 on text columns: header aliases, locale numbers, zone clean-up and
    defaults."""
    c = _by_name(df, schemas.HEADER_ALIASES, partial=False)
    get = lambda n: c.get(n, F.lit(None).cast("string"))
    text = lambda n, default: F.coalesce(F.nullif(get(n), F.lit("")), F.lit(default))
    return df.select(
        X.digits_int(get("habitaciones")).try_cast("int").alias("habitaciones"),
        X.digits_int(get("banos")).try_cast("int").alias("banos"),
        X.locale_number(get("precio")).alias("precio"),
        text("link_inmueble", "").alias("link_inmueble"),
        X.locale_number(get("metros_cuadrados")).alias("metros_cuadrados"),
        text("anunciante", "Desconocido").alias("anunciante"),
        (X.clean_zone(get("zona")) if "zona" in c else F.lit("Desconocido")).alias("zona"),
        text("web", "").alias("web"),
        F.coalesce(X.iso_day(get("fecha_inclusion")), F.to_date(F.lit(today))).alias("fecha_inclusion"),
        text("tipo_de_operacion", "Venta").alias("tipo_de_operacion"),
    )


def read_unified_listings(spark: SparkSession, path: str, today: str, encoding: str = "UTF-8") -> DataFrame:
    """S3"""
    return unified_listings(read_text_csv(spark, path, encoding), today)


def uploaded_listings(df: DataFrame, today: str) -> DataFrame:
    """Substring header aliases, required columns, defaults and the quality
    gate. Raises when a required column is missing."""
    c = _by_name(df, schemas.UPLOAD_ALIASES, partial=True)
    missing = [n for n in schemas.UPLOAD_REQUIRED if n not in c]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    get = lambda n: F.trim(c.get(n, F.lit(None).cast("string")))
    text = lambda n, default: F.coalesce(F.nullif(get(n), F.lit("")), F.lit(default))
    whole = lambda n: F.coalesce(F.nullif(F.regexp_extract(get(n), r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
    out = df.select(
        whole("habitaciones").alias("habitaciones"),
        whole("banos").alias("banos"),
        X.locale_number(get("precio")).alias("precio"),
        text("link_inmueble", "#").alias("link_inmueble"),
        X.locale_number(get("metros_cuadrados")).alias("metros_cuadrados"),
        *[text(n, "Sin especificar").alias(n) for n in ("anunciante", "zona", "web")],
        F.coalesce(X.iso_day(get("fecha_inclusion")), F.to_date(F.lit(today))).alias("fecha_inclusion"),
        derive_operation("text", value=get("tipo_de_operacion")).alias("tipo_de_operacion"),
    )
    return quality_gate(out)


def _positional(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns renamed by position; missing trailing ones are empty text."""
    return df.select(
        *[
            (F.coalesce(F.col(f"`{df.columns[i]}`").cast("string"), F.lit("")) if i < len(df.columns) else F.lit("")).alias(n)
            for i, n in enumerate(names)
        ]
    )


def _leading_number(c: str, default: float | None) -> Column:
    """parseFloat: the number a text starts with."""
    value = F.nullif(F.regexp_extract(F.col(c), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def clients_by_position(df: DataFrame) -> DataFrame:
    """S5 on text columns: 22 columns by position, list literals to arrays,
    rows without id dropped."""
    c = _positional(df, schemas.CLIENTS)
    arrays = ("types", "conditions", "locations", "flags")
    numbers = [n for n in schemas.CLIENTS if n.endswith(("_min", "_max", "_m2", "_eur"))]
    typed = {n: X.list_literal(F.col(n)) for n in arrays} | {n: _leading_number(n, None) for n in numbers}
    return complete_rows(c, "id").withColumns(typed)


def read_clients(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S5"""
    return clients_by_position(read_text_csv(spark, path, encoding))


def matches_by_position(df: DataFrame) -> DataFrame:
    """S6 on text columns: 22 columns by position, numbers default to 0, rows
    without client id, client name or property id dropped."""
    c = _positional(df, schemas.MATCHES)
    numbers = "habitaciones banos m2 precio score s_price s_area s_rooms s_baths s_operation rank_client".split()
    return complete_rows(c, "client_id", "client_name", "property_id").withColumns(
        {n: _leading_number(n, 0.0) for n in numbers}
    )


def read_matches(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S6"""
    return matches_by_position(read_text_csv(spark, path, encoding))


def read_ids(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id per line, first cell, trimmed, blank lines dropped."""
    cell = F.trim(F.regexp_replace(F.split("value", ",", 2)[0], '^"|"$', ""))
    return spark.read.text(path).select(cell.alias(name)).filter(F.length(name) > 0)


def write_ids(ids: DataFrame, path: str, column: str = "id") -> None:
    """S7"""
    ids.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = ("struct", "array", "map")
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV export with minimal quoting."""
    _flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_unified(df: DataFrame, path: str, bom: bool = True) -> None:
    """Unified listings, the byte-order mark put before the first header
    name so that spreadsheet programs read UTF-8."""
    first = df.columns[0]
    flat = _flat(df)
    write_csv(flat.withColumnRenamed(first, BOM + first) if bom else flat, path)


def write_snapshot(df: DataFrame, path: str, day: str, column: str = "snapshot_date") -> None:
    """Replace one day's partition. The committer publishes whole
    files only, and dynamic overwrite leaves every other day as it was."""
    (
        df.withColumn(column, F.to_date(F.lit(day)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    )


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a Parquet table."""
    df.write.mode("append").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All stored days; see latest_before for yesterday's."""
    return spark.read.parquet(path)


def write_counted(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write Parquet and return how many rows were written, observed by the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return seen.get["rows"]
