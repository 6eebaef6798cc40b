"""Domain views over the given tables, one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

LISTINGS = """
select l_orderkey * 10 + l_linenumber as listing_key,
       l_partkey as seq,
       concat('https://portal.example/es/',
              case l_returnflag when 'N' then 'comprar' when 'R' then 'alquiler' else 'otro' end,
              '/', cast(l_orderkey as varchar(20)), '/', cast(l_linenumber as varchar(20)), '/d') as link_inmueble,
       case when l_linenumber = 7 then null else cast(l_linenumber % 6 as int) end as habitaciones,
       cast(l_suppkey % 3 + 1 as int) as banos,
       case when l_quantity >= 49 then null else l_extendedprice end as precio,
       case when l_quantity <= 2 then cast(0 as double) else l_quantity * 4 end as metros_cuadrados,
       s_name as anunciante,
       case when n_nationkey % 5 = 0 then concat(n_name, ' Centro') else n_name end as zona,
       case l_returnflag when 'N' then 'Venta' when 'R' then 'Alquiler' else 'Otro' end as tipo_de_operacion,
       cast(l_shipdate as date) as fecha_inclusion
from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
"""

INVENTORY = """
select p_partkey as property_id,
       cast(50000 + (p_partkey % 97) * 3000 as double) as precio,
       cast(p_size * 4 as double) as m2,
       case when p_partkey % 11 = 0 then null else cast(p_partkey % 6 as int) end as habitaciones,
       cast(p_partkey % 3 + 1 as int) as banos,
       case when p_partkey % 4 = 0 then 'alquiler' else 'venta' end as operacion,
       lower(n_name) as zona_token, lower(r_name) as region_token,
       p_type as tipo, p_name as link_inmueble, 'portal' as web, p_brand as anunciante, n_name as zona
from {part} join {nation} on cast(substr(p_brand, 7) as int) - 1 = n_nationkey
     join {region} on n_regionkey = r_regionkey
"""

CLIENTS = """
select c_custkey as client_id, c_name as nombre,
       concat('6', cast(100000000 + c_custkey as varchar(20))) as telefono,
       concat('c', cast(c_custkey as varchar(20)), '@Mail.example') as mail,
       case when c_custkey % 19 = 0 then 'otro' when c_custkey % 3 = 0 then 'alquiler' else 'venta' end as operation,
       case when c_custkey % 10 = 0 then null else cast(50000 + (c_custkey % 50) * 4000 as double) end as price_min_eur,
       case when c_custkey % 29 = 0 then cast(20000 as double) when c_custkey % 7 = 0 then null
            else cast(90000 + (c_custkey % 50) * 4000 as double) end as price_max_eur,
       case when c_custkey % 4 = 0 then null else cast(20 + c_custkey % 40 as double) end as area_min_m2,
       case when c_custkey % 4 = 1 then null else cast(90 + c_custkey % 80 as double) end as area_max_m2,
       case when c_custkey % 17 = 0 then 9 else cast(c_custkey % 4 as int) end as rooms_min,
       case when c_custkey % 5 = 0 then null else cast(c_custkey % 4 + 2 as int) end as rooms_max,
       case when c_custkey % 6 = 0 then null else cast(c_custkey % 5 as int) end as bath_min,
       cast(null as int) as bath_max,
       case when c_custkey % 13 = 0 then null when c_custkey % 23 = 0 then 'nowhere'
            when c_custkey % 31 = 0 then 'spain'
            when c_custkey % 8 = 0 then lower(r_name) else lower(n_name) end as location_token,
       c_mktsegment as segment, n_name as zona_std
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

HIERARCHY = """
select lower(r_name) as parent, lower(n_name) as child
from {nation} join {region} on n_regionkey = r_regionkey
"""

# One buyer preference per customer, written the way the CRM writes it.
PREFS = """
select c_custkey as id, c_name as nombre,
       concat('Busca <span>',
              case c_custkey % 6 when 0 then 'Piso' when 1 then 'Casa de montaña' when 2 then 'Pisos/ Apartamentos'
                   when 3 then 'Local Comercial' when 4 then 'Habitación' else 'Inmueble' end,
              '</span> , para <span>',
              case when c_custkey % 3 = 0 then 'Alquiler' when c_custkey % 11 = 0 then 'Venta o Alquiler' else 'Venta' end,
              '</span> , ',
              case c_custkey % 5 when 0 then concat('desde ', cast(60 + c_custkey % 90 as varchar(9)), ' m² , ')
                   when 1 then concat('de ', cast(40 + c_custkey % 30 as varchar(9)), ' m² a ', cast(90 + c_custkey % 80 as varchar(9)), ' m² , ')
                   when 2 then concat('hasta ', cast(100 + c_custkey % 60 as varchar(9)), ' m² , ')
                   when 3 then concat('entre ', cast(30 + c_custkey % 30 as varchar(9)), ' m² a ', cast(1 + c_custkey % 7 as varchar(9)), '.', cast(100 + c_custkey % 800 as varchar(9)), ' m² , ')
                   else '' end,
              case c_custkey % 7 when 0 then concat('con ', cast(c_custkey % 4 + 1 as varchar(9)), ' Habitaciones , ')
                   when 1 then concat('desde ', cast(c_custkey % 4 + 1 as varchar(9)), ' Habitaciones , ')
                   when 2 then concat('de ', cast(c_custkey % 3 + 1 as varchar(9)), ' Habitaciones a ', cast(c_custkey % 3 + 3 as varchar(9)), ' Habitaciones , ')
                   when 3 then concat('hasta ', cast(c_custkey % 4 + 1 as varchar(9)), ' Habitaciones , con 2 Baños , ')
                   when 4 then concat('entre 1 Baño a ', cast(c_custkey % 3 + 1 as varchar(9)), ' Baños , desde 1 Salón , ')
                   else '' end,
              case c_custkey % 4 when 0 then concat('hasta ', cast(100 + c_custkey % 900 as varchar(9)), '.000 € , ')
                   when 1 then concat('de ', cast(50 + c_custkey % 50 as varchar(9)), '.000 € a ', cast(120 + c_custkey % 700 as varchar(9)), '.000 € , ')
                   when 2 then concat('desde ', cast(400 + c_custkey % 600 as varchar(9)), ' € , ')
                   else concat('entre ', cast(40000 + c_custkey as varchar(9)), ' € a ', cast(90000 + c_custkey as varchar(9)), ' € , ') end,
              case when c_custkey % 9 = 0 then '<span>reformado</span> , ' else '' end,
              'en ', case c_custkey % 8 when 0 then 'Centre - Zona Alta , Alcoy / Alcoi'
                          when 1 then 'Santa Rosa Alcoy / Alcoi'
                          when 2 then 'Alcoy / Alcoi , Todos los inmuebles'
                          when 3 then 'Eixample , Alcoy / Alcoi o en Batoi , Alcoy / Alcoi'
                          when 4 then concat(n_name, ' , ', r_name)
                          when 5 then concat(n_name, ' , polígono definido')
                          when 6 then 'Batoi o en Viaducto o en Centro o en Norte o en Sud'
                          else n_name end) as pref_text
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

# One free-text location per line item, in the spellings the portals use.
LOCATIONS = """
select l_orderkey * 10 + l_linenumber as id,
       case l_partkey % 24
            when 0 then concat('Santa Rosa, Alcoy / Alcoi') when 1 then 'Centro - Zona Alta'
            when 2 then 'Centre - Zona Alta (Alcoi)' when 3 then 'Ensanche, Alcoy'
            when 4 then 'Zona Norte' when 5 then 'Barri Batoi - Baradello - Sargento, Alcoi'
            when 6 then 'Muro de Alcoy' when 7 then 'Camí, Alcoy' when 8 then 'Alicante (Spain)'
            when 9 then 'Villena, El Mercado - Plaza de Toros' when 10 then 'San Vicente del Raspeig, Haygon - Universidad'
            when 11 then 'España' when 12 then concat('Partida ', cast(l_suppkey % 50 as varchar(9)), ', Cocentaina')
            when 13 then 'Eixampel' when 14 then 'Gormaigg (Alcoi)' when 15 then 'L Alqueria d Asnar'
            when 16 then 'Banyeres de Mariola' when 17 then concat('Urb. ', cast(l_suppkey % 100 as varchar(9)))
            when 18 then 'Els Algars, Alcoi' when 19 then 'zona viaducto' when 20 then '-'
            when 21 then 'Provincia de Alicante' when 22 then null
            else 'Penàguila / Benifallim' end as texto
from {lineitem}
"""

_FX = {"fx_listings": LISTINGS, "fx_inventory": INVENTORY, "fx_clients": CLIENTS,
       "fx_hierarchy": HIERARCHY, "fx_prefs": PREFS, "fx_locations": LOCATIONS}


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    return sql(spark, sf_dir, _FX[name], spread)


def sql(spark: SparkSession, sf_dir: str, text: str, spread: bool = False) -> DataFrame:
    """`spread` deals the rows of the two tables that are small files, read by one or two tasks, out to
    all cores, before they become the long texts or pages on which the work is done."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    if spread:
        n = 2 * spark.sparkContext.defaultParallelism
        names |= {t: f"(select /*+ REPARTITION({n}) */ * from {names[t]})" for t in ("customer", "part")}
    return spark.sql(text.format(**names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(body: str) -> str:
    """DuckDB text: the fixture views it mentions, then `body`."""
    plain = {t: t for t in TABLES}
    used = [n for n in _FX if re.search(rf"\b{n}\b", body)]
    ctes = ", ".join(f"{n} as ({_FX[n].format(**plain)})" for n in used)
    body = body.strip()
    if not used:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return re.sub(r"(?i)^with\s+recursive\b", f"with recursive {ctes}, ", body, count=1)
    if re.match(r"(?i)with\b", body):
        return re.sub(r"(?i)^with\b", f"with {ctes}, ", body, count=1)
    return f"with {ctes} {body}"
