"""Schema shaping of listings and clients."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_engine.functions import text as X
from listing_engine.functions import zones as Z
from listing_engine.operators.ordering import running_total
from listing_engine.rules.advertisers import ADVERTISER_ALIASES

# Portal label of each source.
WEB = {"a": "Fotocasa", "b": "Idealista", "c": "Picó Blanes"}
# Texts shown where a value is missing.
PRICE_UNKNOWN, AREA_UNKNOWN, ADVERTISER_UNKNOWN, ZONE_UNKNOWN = "A consultar", "Desconocido", "Particular", "Desconocido"
UNIFIED = (
    "habitaciones banos precio link_inmueble metros_cuadrados anunciante zona tipo_de_operacion fecha_inclusion"
).split()

# canonical name -> (accepted names, type)
LISTING_FIELDS = {
    "habitaciones": (("habitaciones",), "int"),
    "banos": (("banos", "baños", "baños_"), "int"),
    "precio": (("precio",), "double"),
    "link_inmueble": (("link_inmueble",), "raw"),
    "m2": (("m2", "metros_cuadrados"), "double"),
    "anunciante": (("anunciante",), "text"),
    "zona": (("zona",), "raw"),
    "operacion": (("operacion", "tipo_de_operacion"), "text"),
    "web": (("web",), "text"),
    "tipo": (("tipo", "tipo_inmueble"), "text"),
}


def _source(df: DataFrame, names: tuple[str, ...]) -> Column:
    hit = next((n for n in names if n in df.columns), None)
    return F.lit(None).cast("string") if hit is None else F.col(f"`{hit}`").cast("string")


def normalize_listings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical names, missing columns back-filled, typed and normalized.
    P6 supplies property_id where the input has no id_inmueble."""
    shaped = {}
    for name, (accepted, kind) in LISTING_FIELDS.items():
        c = _source(df, accepted)
        shaped[name] = {
            "int": X.to_int,
            "double": X.to_float,
            "text": X.normalize_text,
            "raw": lambda x: F.coalesce(x, F.lit("")),
        }[kind](c)
    shaped["zona_norm"] = X.normalize_text(_source(df, ("zona",)))
    out = df.select(*keep, *[c.alias(n) for n, c in shaped.items()], *(["id_inmueble"] if "id_inmueble" in df.columns else []))
    pid = F.col("id_inmueble").cast("string") if "id_inmueble" in df.columns else property_id(F.col("link_inmueble"), F.col("web"))
    return out.withColumn("property_id", pid)


CLIENT_INTS = ("rooms_min", "rooms_max", "bath_min", "bath_max", "living_min", "living_max")
CLIENT_DOUBLES = ("area_min_m2", "area_max_m2", "price_min_eur", "price_max_eur")
CLIENT_TEXTS = ("nombre", "telefono", "mail", "creado_info", "zona_std")
CLIENT_LISTS = {"types": "type_tokens", "conditions": "cond_tokens", "flags": "flag_tokens"}


def normalize_clients(df: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Typed bounds, normalized texts and token arrays, ready for matching.

    List fields may be arrays, list literals or comma-separated text. Location
    tokens come from `locations`, or else from `zona_std`; `client_id` is the
    input's, or else its `id`."""
    def tokens(name: str) -> Column:
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            normal = F.transform(F.col(name), lambda x: X.normalize_text(x))
            return F.coalesce(F.array_distinct(F.filter(normal, lambda x: F.length(x) > 0)), F.array().cast("array<string>"))
        return X.preference_tokens(_source(df, (name,)))

    cols = {n: X.to_int(_source(df, (n,))) for n in CLIENT_INTS}
    cols |= {n: X.to_float(_source(df, (n,))) for n in CLIENT_DOUBLES}
    cols |= {n: X.normalize_text(_source(df, (n,))) for n in CLIENT_TEXTS}
    cols |= {target: tokens(n) for n, target in CLIENT_LISTS.items()}
    cols["operation_tokens"] = X.operation_tokens(tokens("operation"))
    cols["operation"] = F.array_join(X.operation_tokens(tokens("operation")), ",")
    located = tokens("locations")
    cols["locations"] = F.when(F.size(located) > 0, located).otherwise(X.parse_list_field(_source(df, ("zona_std",))))
    own = next((n for n in ("client_id", "id") if n in df.columns), None)
    named = [F.col(own).alias("client_id")] if own and "client_id" not in keep else []
    out = df.select(*keep, *named, *[c.alias(n) for n, c in cols.items()])
    return out.withColumn("location_tokens", Z.location_tokens(F.col("locations")))


def property_id(link: Column, web: Column, portable: bool = False) -> Column:
    """Stable surrogate of (link, web). `portable` uses an md5 prefix that
    other engines can recompute."""
    link, web = F.trim(F.coalesce(link, F.lit(""))), F.trim(F.coalesce(web, F.lit("")))
    if portable:
        return F.conv(F.substring(F.md5(F.concat_ws("|", link, web)), 1, 8), 16, 10).cast("bigint")
    return F.xxhash64(link, web)


def positional_id(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """1-based position in the given order, counted per range of rows (see running_total)."""
    columns = df.columns
    return running_total(df, F.lit(1), *order, name="pos__").select(F.col("pos__").cast("bigint").alias(name), *columns)


def derive_operation(source: str, link: Column | None = None, title: Column | None = None, value: Column | None = None) -> Column:
    """From the link path (a), the title (b), the stated value (c) or free
    text in Spanish or English (text)."""
    if source == "a":
        return F.when(link.contains("/comprar/"), "Venta").when(link.contains("/alquiler/"), "Alquiler").otherwise("Otro")
    if source == "b":
        t = F.lower(title)
        return F.when(t.contains("venta"), "Venta").when(t.contains("alquiler"), "Alquiler").otherwise("Otro")
    if source == "c":
        return F.coalesce(F.when(value == "Alquiler opción a compra", "Alquiler").otherwise(value), F.lit("Otro"))
    t = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(t.rlike("venta|compra|sale"), "Venta").when(t.rlike("alquiler|rent"), "Alquiler").otherwise("Otro")


def map_advertiser(name: Column) -> Column:
    """Alias table lookup, unknown names pass through."""
    table = F.create_map(*[F.lit(x) for x in chain(*ADVERTISER_ALIASES.items())])
    return F.coalesce(table[name], name)


def project_source(df: DataFrame, source: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """P3 + P4: the unified columns of one source; source c has a fixed
    advertiser. Expects the zone as `zona_std` and fecha_inclusion."""
    renames = {"precio_eur": "precio", "url": "link_inmueble", "superficie_construida_m2": "metros_cuadrados", "baños": "banos"}
    have = {renames.get(c, c): c for c in df.columns}
    advertiser = F.lit(WEB["c"]) if source == "c" else F.col("anunciante")
    picked = {
        "habitaciones": F.col("habitaciones"),
        "banos": F.col(f"`{have['banos']}`"),
        "precio": F.col(have["precio"]).cast("double"),
        "link_inmueble": F.col(have["link_inmueble"]),
        "metros_cuadrados": F.col(have["metros_cuadrados"]).cast("double"),
        "anunciante": advertiser,
        "zona": F.col("zona_std"),
        "tipo_de_operacion": F.col("tipo_de_operacion"),
        "fecha_inclusion": F.col("fecha_inclusion"),
    }
    return df.select(*[c.alias(n) for n, c in picked.items()], F.lit(WEB[source]).alias("web"), *extra)


def default_nulls(df: DataFrame, zone_name: Column | None = None) -> DataFrame:
    """P5: numbers stay numbers; the display labels are separate columns."""
    zone = F.col("zona") if zone_name is None else zone_name
    label = lambda c, unknown: F.coalesce(F.col(c).cast("string"), F.lit(unknown))
    return df.withColumns(
        {
            "habitaciones": F.coalesce(F.col("habitaciones").cast("int"), F.lit(0)),
            "banos": F.coalesce(F.col("banos").cast("int"), F.lit(0)),
            "precio_label": label("precio", PRICE_UNKNOWN),
            "m2_label": label("metros_cuadrados", AREA_UNKNOWN),
            "anunciante": F.coalesce("anunciante", F.lit(ADVERTISER_UNKNOWN)),
            "zona_label": F.coalesce(F.when(zone != "-", zone), F.lit(ZONE_UNKNOWN)),
        }
    )


def compose_location(*parts: Column) -> Column:
    """P10: non-empty parts joined by ', '."""
    return F.concat_ws(", ", *[F.when(F.length(p) > 0, p) for p in parts])


def derive_title(reference: Column, kind: Column, zone: Column, city: Column) -> Column:
    """P10: the reference, else '<type> en <zone or city>'."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    place = F.coalesce(filled(zone), filled(city), F.lit(""))
    return F.coalesce(filled(reference), F.trim(F.concat(F.coalesce(kind, F.lit("")), F.lit(" en "), place)))


def surface(built: Column, usable: Column) -> Column:
    """P11"""
    return F.coalesce(built, usable)
