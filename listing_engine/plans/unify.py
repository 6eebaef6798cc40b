"""Three portal schemas into one listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_engine.functions.zones import location_tokens, standardize_texts
from listing_engine.operators import shaping as H
from listing_engine.operators.dedupe import keep_first_link, union_all
from listing_engine.session import cut_lineage


def standardize_zones(df: DataFrame, column: str, key: str | None = None, target: str = "zona_std") -> DataFrame:
    """Zone struct of a text column, or array of structs of an array
    column (`key` identifies the row then).

    Every distinct text is worked out once: the distinct combines per task
    before it shuffles, and the result joins back on the text, broadcast only
    if Spark measures it small enough.
    """
    is_list = df.schema[column].dataType.typeName() == "array"
    if not is_list:
        texts = df.select(F.col(column).alias("text__")).filter(F.col("text__").isNotNull()).distinct()
        zones = standardize_texts(texts, "text__").withColumnRenamed("zone", target)
        return df.join(zones, F.col(column) == F.col("text__"), "left").drop("text__")
    items = df.select(key, F.posexplode(column).alias("pos__", "text__"))
    zones = standardize_texts(items.select("text__").filter(F.col("text__").isNotNull()).distinct(), "text__")
    lists = (
        items.join(zones, "text__")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("pos__", "zone"))).alias("z__"))
        .select(key, F.transform("z__", lambda x: x["zone"]).alias(target))
    )
    empty = F.array().cast(lists.schema[target].dataType)
    joined = df.join(lists, key, "left")
    return joined.withColumn(target, F.when(F.col(column).isNotNull(), F.coalesce(target, empty)))


def tokens_once(df: DataFrame, column: str, target: str = "tokens") -> DataFrame:
    """`df` with the location tokens of a text column, worked out once for each distinct text (null too) and joined back."""
    texts = df.select(F.col(column).alias("text__")).distinct()
    known = texts.select("text__", location_tokens(F.array("text__")).alias(target))
    return df.join(known, F.col(column).eqNullSafe(F.col("text__")), "left").drop("text__")


def unify_listings(a: DataFrame, b: DataFrame, c: DataFrame, seq: str = "seq") -> DataFrame:
    """Operation, advertiser alias, zone, common columns, union, defaults,
    and one row per link, the first source first.

    a: zona, link_inmueble; b: localizacion, titulo; c: zona,
    tipo_de_operacion; each with `seq`, its own row order. Zones are worked out
    once, over the distinct texts that are left when the sources are united and
    repeated links are gone.
    """
    ready = {
        "a": a.withColumns({"zona_std": F.col("zona"), "tipo_de_operacion": H.derive_operation("a", link=F.col("link_inmueble")), "anunciante": H.map_advertiser(F.col("anunciante"))}),
        "b": b.withColumns({"zona_std": F.col("localizacion"), "tipo_de_operacion": H.derive_operation("b", title=F.col("titulo")), "anunciante": H.map_advertiser(F.col("anunciante"))}),
        "c": c.withColumns({"zona_std": F.col("zona"), "tipo_de_operacion": H.derive_operation("c", value=F.col("tipo_de_operacion"))}),
    }
    parts = [
        H.project_source(df.withColumnRenamed(seq, "seq"), s, extra=("seq",)).withColumn("source_rank", F.lit(rank))
        for rank, (s, df) in enumerate(ready.items())
    ]
    union = union_all(*parts)
    ties = ("precio", "metros_cuadrados", "habitaciones", "banos", "anunciante", "fecha_inclusion", "zona")
    first = keep_first_link(union, "source_rank", "seq", *ties).drop("source_rank", "seq")
    zoned = standardize_zones(first.withColumnRenamed("zona", "zona_texto"), "zona_texto", target="zona")
    return H.default_nulls(zoned.select(*first.columns), F.col("zona.zona"))


def matching_input(unified: DataFrame) -> DataFrame:
    """Unified listings as the matcher reads them: normalized columns, surrogate
    id and location tokens of the structured zone, worked out once for each
    distinct zone (or label, where there is none) of the kept rows."""
    label = F.when(F.col("zona").isNull(), F.col("zona_label"))
    # the rules of zones are long expressions, which both branches would plan and run again
    unified = cut_lineage(unified.withColumn("label__", label))
    z = F.col("zona")
    texts = F.filter(
        F.concat(F.array(z["zona"], z["municipio"], z["barrio"], z["subzona"]), F.coalesce(z["extras"], F.array().cast("array<string>"))),
        lambda t: t.isNotNull(),
    )
    tokens = F.when(z.isNull(), location_tokens(F.array("label__"))).otherwise(location_tokens(texts, z["municipio"]))
    known = unified.select("zona", "label__").distinct()
    known = known.select(F.col("zona").alias("of_zona__"), F.col("label__").alias("of_label__"), tokens.alias("zona_tokens"))
    same = F.col("zona").eqNullSafe(F.col("of_zona__")) & F.col("label__").eqNullSafe(F.col("of_label__"))
    flat = unified.join(known, same, "left").drop("of_zona__", "of_label__", "label__").withColumn("zona", F.col("zona_label"))
    return H.normalize_listings(flat, keep=("zona_tokens",))
