"""Loading rules of the file readers, and the three-source unification, over
text tables written from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from listing_engine.operators.matching import expand_locations
from listing_engine.plans import unify as U
from listing_engine.session import scratch_folder
from listing_engine.sources import files as L
from workload.fixtures import sql, table, view, with_views

RAW = """select concat(cast(l_linenumber as varchar(9)), ' hab') as Rooms, case when l_suppkey % 4 = 0 then '' else cast(l_suppkey % 3 as varchar(9)) end as Bathrooms,
  concat(cast(l_partkey as varchar(9)), '.500,25 €') as Price, concat(cast(l_suppkey as varchar(9)), ' m2') as m2, s_name as Agent,
  case l_linenumber when 1 then '' when 2 then concat('(''', s_name, ' / Centre'', {{}})') else concat('"', s_name, '"') end as Location,
  case when l_linenumber = 3 then null else substr(cast(l_shipdate as varchar(30)), 1, 10) end as Fecha, case when l_linenumber = 4 then '' else 'Alquiler' end as Type,
  concat('u', cast(l_orderkey as varchar(20))) as url
  from {lineitem} join {supplier} on l_suppkey = s_suppkey"""

UPLOAD = """select cast(l_linenumber - 1 as varchar(9)) as n_bedrooms, cast(l_suppkey % 3 as varchar(9)) as total_baths, case when l_suppkey % 5 = 0 then 'consultar' else concat('$', cast(l_partkey as varchar(9)), '.50') end as price_eur,
  cast(l_suppkey % 4 as varchar(9)) as sqm, s_name as zone_name, case l_linenumber when 2 then 'For SALE' when 3 then 'rental' when 4 then 'Venta' else 'permuta' end as operation_type,
  concat('u', cast(l_orderkey as varchar(20))) as enlace from {lineitem} join {supplier} on l_suppkey = s_suppkey"""

CLIENTS_RAW = """select case when c_custkey % 20 = 0 then '' else cast(c_custkey as varchar(20)) end as c0, c_name as c1, null as c2, '' as c3, '' as c4, '' as c5, 'venta' as c6,
  concat('[''', c_mktsegment, ''']') as c7, 'null' as c8, '3 hab' as c9, '' as c10, 'x' as c11, '2.5' as c12, '' as c13, '' as c14, '60' as c15, '' as c16,
  concat(cast(c_custkey as varchar(20)), '.0') as c17, '' as c18, c_name as c19, '' as c20, c_mktsegment as c21 from {customer}"""

MATCHES_RAW = """select cast(o_custkey as varchar(20)) as a, case when o_orderkey % 9 = 0 then '' else 'n' end as b, cast(o_orderkey as varchar(20)) as c, 'l' as d, 'w' as e, 'an' as f, 'z' as g, 'venta' as h, '' as i,
  '3' as j, 'null' as k, '70.5' as l, '' as m, '0.81' as n, '0.9' as o, '' as p, 'x' as q, '1' as r, '1' as s, '1' as t, '' as u, '4' as v from {orders}"""

# three portals with overlapping links
SRC = """select l_orderkey as seq, concat('https://p.example/', case when l_suppkey % 2 = 0 then 'comprar' else 'alquiler' end, '/', cast(l_orderkey as varchar(20))) as link_inmueble,
   case when l_linenumber = 2 then null else l_linenumber end as habitaciones, cast(l_linenumber % 3 as int) as banos, case when l_quantity > 45 then null else l_extendedprice end as precio,
   l_quantity as metros_cuadrados, case when l_suppkey % 6 = 0 then 'Buve' when l_suppkey % 6 = 1 then null else 'Agencia' end as anunciante,
   case l_partkey % 4 when 0 then 'Santa Rosa, Alcoy / Alcoi' when 1 then 'Villena' when 2 then null else 'Batoi (Alcoi)' end as zona,
   case when l_partkey % 3 = 0 then 'Piso en VENTA' when l_partkey % 3 = 1 then 'Casa en alquiler' else 'Nave' end as titulo,
   case when l_partkey % 3 = 0 then 'Alquiler opción a compra' when l_partkey % 3 = 1 then 'Venta' end as tipo_de_operacion, cast(l_shipdate as date) as fecha_inclusion, l_returnflag
   from {lineitem}"""


def _sources(s, d):
    src = sql(s, d, SRC)
    a = src.filter("l_returnflag = 'N'").drop("tipo_de_operacion", "titulo")
    b = src.filter("l_returnflag = 'R'").withColumnRenamed("zona", "localizacion").drop("tipo_de_operacion")
    c = src.filter("l_returnflag = 'A'").drop("anunciante")
    c = c.withColumnsRenamed({"precio": "precio_eur", "link_inmueble": "url", "metros_cuadrados": "superficie_construida_m2"})
    return a, b, c


def unify(s, d):
    out = U.unify_listings(*_sources(s, d))
    return out.select(
        "link_inmueble", "habitaciones", "banos", "precio", "metros_cuadrados", "anunciante", F.col("zona.municipio").alias("municipio"),
        F.col("zona.barrio").alias("barrio"), "zona_label", "tipo_de_operacion", "web", "fecha_inclusion",
        F.when(F.col("precio").isNull(), F.col("precio_label")).alias("precio_falta"))


def unified_tokens(s, d):
    """Location tokens of the unified listings, as the matcher joins on them."""
    m = U.matching_input(U.unify_listings(*_sources(s, d)))
    return m.select("link_inmueble", "operacion", "m2", F.array_join(F.array_sort("zona_tokens"), "|").alias("tokens"))


def mixed_encodings(s, d):
    """A folder whose files are partly UTF-8 and partly ISO-8859-1, written and read back."""
    folder = scratch_folder(s, "csv")
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Peña, ¡"), "c_name", F.lit('" ')).alias("nombre"), F.lit(None).cast("string").alias("vacio"))
    for parity, code in enumerate(L.ENCODINGS):
        part = rows.filter(F.col("id") % 2 == parity)
        part.write.mode("append").option("header", True).option("escape", '"').option("encoding", code).csv(folder)
    return L.read_text_csv(s, folder)


def stored_days(s, d):
    """Two days written, one of them again, rows appended to a table of their own, ids as text: all read back."""
    folder = scratch_folder(s, "days")
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("precio"))
    for day, kept in (("2024-05-01", "id % 3 = 0"), ("2024-05-02", "id % 3 = 1"), ("2024-05-02", "id % 3 = 2")):
        L.write_snapshot(rows.filter(kept), f"{folder}/days", day)
    for rest in (0, 1):
        L.append_rows(rows.filter(F.col("id") % 5 == rest), f"{folder}/added")
    L.write_ids(rows.filter("id % 7 = 0").select(F.col("id").cast("string").alias("id")).distinct(), f"{folder}/ids")
    ids = L.read_ids(s, f"{folder}/ids").select(F.lit("ids").alias("what"), F.col("id").cast("bigint").alias("id"), F.lit(None).cast("double").alias("precio"))
    days = L.read_snapshots(s, f"{folder}/days").select(F.col("snapshot_date").cast("string").alias("what"), "id", "precio")
    added = s.read.parquet(f"{folder}/added").select(F.lit("added").alias("what"), "id", "precio")
    return days.unionByName(added).unionByName(ids)


def expanded(s, d):
    """Client tokens with the municipalities of a region token."""
    none = F.array().cast("array<string>")
    c = view(s, d, "fx_clients").withColumn("location_tokens", F.when(F.col("location_token").isNull(), none).otherwise(F.array("location_token")))
    e = expand_locations(c, view(s, d, "fx_hierarchy"))
    return e.select("client_id", F.array_join(F.array_sort("specific_tokens"), "|").alias("tokens"))


def _unify_cte() -> str:
    plain = SRC.replace("{lineitem}", "lineitem")
    return f"""with src as ({plain}), u as (
        select *, case l_returnflag when 'N' then 0 when 'R' then 1 else 2 end as rank, case l_returnflag when 'N' then 'Fotocasa' when 'R' then 'Idealista' else 'Picó Blanes' end as web,
          case l_returnflag when 'N' then case when link_inmueble like '%/comprar/%' then 'Venta' else 'Alquiler' end
             when 'R' then case when titulo like '%VENTA%' then 'Venta' when titulo like '%alquiler%' then 'Alquiler' else 'Otro' end
             else case tipo_de_operacion when 'Venta' then 'Venta' when 'Alquiler opción a compra' then 'Alquiler' else 'Otro' end end as op,
          case when l_returnflag = 'A' then 'Picó Blanes' when anunciante = 'Buve' then 'BUVE' else anunciante end as ad from src),
        f as (select * from (select *, row_number() over (partition by link_inmueble order by rank, seq, precio nulls first, metros_cuadrados, habitaciones nulls first, banos, ad nulls first,
          fecha_inclusion, case zona when 'Villena' then 3 when 'Santa Rosa, Alcoy / Alcoi' then 2 when 'Batoi (Alcoi)' then 1 else 0 end) as rn from u) where rn = 1)"""


QUERIES = {
    "read_unified_rules": lambda s, d: L.unified_listings(sql(s, d, RAW), "2024-05-05"),
    "read_upload_rules": lambda s, d: L.uploaded_listings(sql(s, d, UPLOAD), "2024-05-05"),
    "read_clients_rules": lambda s, d: L.clients_by_position(sql(s, d, CLIENTS_RAW)).select(
        "id", "nombre", "rooms_min", "bath_min", "bath_max", "area_min_m2", "price_min_eur", "price_max_eur",
        *[F.array_join(c, "|").alias(c) for c in ("types", "conditions", "locations", "flags")]),
    "read_matches_rules": lambda s, d: L.matches_by_position(sql(s, d, MATCHES_RAW)).select(
        "client_id", "property_id", "habitaciones", "banos", "m2", "precio", "score", "s_rooms", "zone_match", "rank_client"),
    "unify_listings": unify,
    "unified_tokens": unified_tokens,
    "expanded_locations": expanded,
    "csv_mixed_encodings": mixed_encodings,
    "stored_days": stored_days,
}

ORACLE = {
    "read_unified_rules": """select l_linenumber as habitaciones, case when l_suppkey % 4 = 0 then 0 else (l_suppkey % 3)::int end as banos, (l_partkey || '500.25')::double as precio, 'u' || l_orderkey as link_inmueble,
        (l_suppkey || '2')::double as metros_cuadrados, s_name as anunciante, case l_linenumber when 1 then 'Desconocido' when 2 then s_name || ' / Centre' else s_name end as zona, '' as web,
        case when l_linenumber = 3 then date '2024-05-05' else l_shipdate::date end as fecha_inclusion, case when l_linenumber = 4 then 'Venta' else 'Alquiler' end as tipo_de_operacion
        from lineitem join supplier on l_suppkey = s_suppkey""",
    "read_upload_rules": """select l_linenumber - 1 as habitaciones, (l_suppkey % 3)::int as banos, (l_partkey || '.50')::double as precio, 'u' || l_orderkey as link_inmueble, (l_suppkey % 4)::double as metros_cuadrados,
        'Sin especificar' as anunciante, s_name as zona, 'Sin especificar' as web, date '2024-05-05' as fecha_inclusion,
        case l_linenumber when 2 then 'Venta' when 3 then 'Alquiler' when 4 then 'Venta' else 'Otro' end as tipo_de_operacion
        from lineitem join supplier on l_suppkey = s_suppkey where l_linenumber > 1 and l_suppkey % 5 <> 0 and l_suppkey % 4 > 0""",
    "read_clients_rules": """select c_custkey::varchar as id, c_name as nombre, 3.0::double as rooms_min, null::double as bath_min, 2.5::double as bath_max, 60.0::double as area_min_m2, c_custkey::double as price_min_eur,
        null::double as price_max_eur, c_mktsegment as types, '' as conditions, c_name as locations, '' as flags from customer where c_custkey % 20 <> 0""",
    "read_matches_rules": """select o_custkey::varchar as client_id, o_orderkey::varchar as property_id, 3.0::double as habitaciones, 0.0::double as banos, 70.5::double as m2, 0.0::double as precio, 0.81::double as score,
        0.0::double as s_rooms, '1' as zone_match, 4.0::double as rank_client from orders where o_orderkey % 9 <> 0""",
    "unify_listings": _unify_cte() + """ select link_inmueble, coalesce(habitaciones, 0)::int as habitaciones, banos, precio, metros_cuadrados, coalesce(ad, 'Particular') as anunciante,
        case zona when 'Villena' then 'Villena' when 'Santa Rosa, Alcoy / Alcoi' then 'Alcoi' when 'Batoi (Alcoi)' then 'Alcoi' end as municipio,
        case zona when 'Santa Rosa, Alcoy / Alcoi' then 'Santa Rosa' when 'Batoi (Alcoi)' then 'Batoi' end as barrio,
        case zona when 'Villena' then 'Villena' when 'Santa Rosa, Alcoy / Alcoi' then 'Alcoi / Santa Rosa' when 'Batoi (Alcoi)' then 'Alcoi / Batoi' else 'Desconocido' end as zona_label,
        op as tipo_de_operacion, web, fecha_inclusion, case when precio is null then 'A consultar' end as precio_falta from f""",
    "unified_tokens": _unify_cte() + """ select link_inmueble, lower(op) as operacion, metros_cuadrados as m2,
        case zona when 'Villena' then 'villena' when 'Santa Rosa, Alcoy / Alcoi' then
          'alcoi|alcoy|alicante (provincia)|alicante province|alicante provincia|province of alicante|provincia alicante|provincia de alicante|santa rosa'
          when 'Batoi (Alcoi)' then 'alcoi|alcoy|alicante (provincia)|alicante province|alicante provincia|batoi|province of alicante|provincia alicante|provincia de alicante' else 'desconocido' end as tokens from f""",
    "csv_mixed_encodings": "select c_custkey::varchar as id, trim('Peña, ¡' || c_name || '\" ') as nombre, cast(null as varchar) as vacio from customer",
    "stored_days": """with o as (select o_orderkey as id, o_totalprice as precio from orders)
        select '2024-05-01' as what, id, precio from o where id % 3 = 0 union all select '2024-05-02', id, precio from o where id % 3 = 2
        union all select 'added', id, precio from o where id % 5 < 2 union all select distinct 'ids', id, null::double from o where id % 7 = 0""",
    "expanded_locations": """select client_id, case when location_token = 'spain' or location_token is null then '' else coalesce((select string_agg(t, '|' order by t) from
        (select c.location_token as t union select child from fx_hierarchy h where h.parent = c.location_token)), '') end as tokens from fx_clients c""",
}
ORACLE = {k: with_views(v) for k, v in ORACLE.items()}
