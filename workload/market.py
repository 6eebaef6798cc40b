"""Explore: facets, analytics, sorts and pages over the listing view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.operators import aggregates as A
from listing_engine.operators import filters as P
from listing_engine.operators import ordering as T
from listing_engine.operators import shaping as H
from workload.fixtures import view, with_views

TIES = ("listing_key", "seq", "link_inmueble", "precio", "metros_cuadrados", "anunciante", "fecha_inclusion")
TODAY = "1998-06-15"


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_listings")


def r4(df: DataFrame) -> DataFrame:
    """Doubles to 4 decimals, so that summation order does not show."""
    cut = lambda c: F.floor(F.col(c) * 1e4 + 0.5) / 1e4
    return df.select(*[cut(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def _r(e: str) -> str:
    return f"floor(({e})::double * 1e4 + 0.5) / 1e4"


STRATEGIC = "(contains(lower(zona), 'barr') or contains(lower(zona), 'centro') or contains(lower(zona), 'desconocido'))"
ZEROED = """z as (select * replace (coalesce(precio, 0) as precio, coalesce(metros_cuadrados, 0) as metros_cuadrados,
     coalesce(habitaciones, 0) as habitaciones), %s as strategic,
     case when metros_cuadrados > 0 then coalesce(precio, 0) / metros_cuadrados end as pm2 from fx_listings)""" % STRATEGIC


def _mean(value: str, cond: str) -> str:
    return f"coalesce(avg({value}) filter (where {cond}), 0)"


V, R = "tipo_de_operacion = 'Venta'", "tipo_de_operacion = 'Alquiler'"
ZONES = f"""zs as (select zona, count(*) as count, count(*) filter (where {V}) as sale_count,
      count(*) filter (where {R}) as rent_count, {_mean('precio', V)} as avg_price_sale, {_mean('precio', R)} as avg_price_rent,
      {_mean('pm2', V)} as avg_price_m2_sale, {_mean('pm2', R)} as avg_price_m2_rent, avg(metros_cuadrados) as avg_size,
      coalesce(min(precio) filter (where {V}), 0) as min_price_sale, coalesce(max(precio) filter (where {V}), 0) as max_price_sale,
      coalesce(min(precio) filter (where {R}), 0) as min_price_rent, coalesce(max(precio) filter (where {R}), 0) as max_price_rent,
      count(*) / (select count(*) from z) * 100.0::double as market_share,
      count(*) filter (where {V}) / (select count(*) from z where {V}) * 100.0::double as sale_share,
      count(*) filter (where {R}) / (select count(*) from z where {R}) * 100.0::double as rent_share,
      {STRATEGIC} as is_strategic from z group by zona)"""
ZONE_COLS = (
    "zona, count, sale_count, rent_count, is_strategic, "
    + ", ".join(
        f"{_r(c)} as {c}"
        for c in "avg_price_sale avg_price_rent avg_price_m2_sale avg_price_m2_rent avg_size min_price_sale max_price_sale "
        "min_price_rent max_price_rent market_share sale_share rent_share".split()
    )
)
COMPETITORS = f"""cs as (select anunciante, count(*) as count, count(*) filter (where {V}) as sale_count,
      count(*) filter (where {R}) as rent_count, {_r(_mean('precio', V))} as avg_price_sale, {_r(_mean('precio', R))} as avg_price_rent,
      {_r('avg(metros_cuadrados)')} as avg_size, count(distinct zona) as zones_count,
      count(distinct zona) filter (where strategic) as strategic_zones_count, count(distinct tipo_de_operacion) as types_count,
      {_r('min(precio)')} as min_price, {_r('max(precio)')} as max_price,
      {_r('count(*) / (select count(*) from z) * 100.0::double')} as market_share,
      {_r('count(distinct zona) filter (where strategic) / (select count(distinct zona) from z where strategic) * 100.0::double')} as strategic_presence
      from z group by anunciante)"""
DAYS = f"""select fecha_inclusion as date, count(*) as count, count(*) filter (where {V}) as sale_count,
      count(*) filter (where {R}) as rent_count, {_r(_mean('precio', V))} as avg_price_sale, {_r(_mean('precio', R))} as avg_price_rent,
      {_r(f'coalesce(sum(precio) filter (where {V}), 0)')} as total_value_sale,
      {_r(f'coalesce(sum(precio) filter (where {R}), 0)')} as total_value_rent from z group by 1"""


def _op_row(op: str) -> str:
    c = f"tipo_de_operacion = '{op}'"
    return f"""select '{op}' as tipo, count(*) filter (where {c}) as count, {_r(_mean('precio', c))} as avg_price,
      {_r(_mean('metros_cuadrados', c))} as avg_size, {_r(f'count(*) filter (where {c}) / count(*) * 100.0::double')} as market_share,
      {_r(f'coalesce(sum(precio) filter (where {c}), 0)')} as total_value from z"""


# neighbourhoods by part number, so that prices per m2 differ between zones
FINE_ZONE = "concat('Barrio ', cast(cast(floor(seq / 50) as int) as varchar(9)))"

FACETS = dict(
    operations=["Venta", "Alquiler"], baths=2, price_min=20000, price_max=60000, area_min=40, area_max=180,
    zones=[f"NATION_{i}" for i in (1, 2, 3, 7, 11)],
)

OUT = "listing_key, seq, link_inmueble, precio, metros_cuadrados, anunciante, zona, tipo_de_operacion, fecha_inclusion"
OUT_COLS = OUT.split(", ")


def _window(mode: str, **kw):
    return lambda s, d: P.date_window(listings(s, d), mode, TODAY, **kw).select(*OUT_COLS)


def _window_sql(cond: str) -> str:
    return f"select {OUT} from fx_listings where {cond}"


def _dir(direction: str) -> str:
    return "desc nulls last" if direction == "desc" else "asc nulls first"


QUERIES = {
    "kpi_market": lambda s, d: r4(A.market_kpis(listings(s, d))),
    "kpi_market_missing_excluded": lambda s, d: r4(A.market_kpis(listings(s, d), missing_as_zero=False)),
    "zone_stats": lambda s, d: r4(A.zone_stats(listings(s, d))),
    "competitor_stats": lambda s, d: r4(A.competitor_stats(listings(s, d))),
    "daily_series": lambda s, d: r4(A.daily_series(listings(s, d))),
    "rooms_stats": lambda s, d: r4(A.rooms_stats(listings(s, d))),
    "operation_stats": lambda s, d: r4(A.operation_stats(listings(s, d))),
    "strategic_summary": lambda s, d: r4(A.strategic_summary(listings(s, d))),
    "strategic_opportunities": lambda s, d: r4(A.strategic_opportunities(
        listings(s, d).withColumn("zona", F.expr(FINE_ZONE)))),
    "listing_facet_filter": lambda s, d: P.filter_listings(listings(s, d), **FACETS).select(*OUT_COLS),
    "date_window_today": _window("today"),
    "date_window_yesterday": _window("yesterday"),
    "date_window_last7": _window("last7days"),
    "date_window_last30": _window("last30days"),
    "date_window_custom": _window("custom", date_from="1998-03-01", date_to="1998-03-20"),
    "date_window_open_start": _window("custom", date_to="1995-02-10"),
    "quality_gate": lambda s, d: P.quality_gate(listings(s, d)).select(*OUT_COLS),
    "strategic_zone_filter": lambda s, d: listings(s, d).filter(P.strategic_zone(F.col("zona"))).select(*OUT_COLS),
    "exclude_agencies": lambda s, d: P.exclude_agencies(
        listings(s, d), "anunciante", exact=["supplier#000000003"], contains=["#00000001", "é#00000002"]
    ).select(*OUT_COLS),
    "facet_zones": lambda s, d: A.facet_values(listings(s, d), "zona"),
    "facet_advertisers": lambda s, d: A.facet_values(listings(s, d), "anunciante"),
    "facet_operations": lambda s, d: A.facet_values(listings(s, d), "tipo_de_operacion"),
    "value_counts": lambda s, d: A.value_counts(listings(s, d), "zona"),
    "value_counts_explode": lambda s, d: A.value_counts(
        listings(s, d).select(F.split("link_inmueble", "/").alias("parts")), "parts"
    ),
    "location_freq": lambda s, d: A.location_frequency(
        listings(s, d).select(F.split(F.concat_ws("|", "zona", "anunciante"), r"\|").alias("locations"))
    ),
    "listing_sort_page": lambda s, d: T.page(
        T.sort_listings(listings(s, d), "precio", "desc", *TIES), 3, 30
    ).select(*OUT_COLS),
    "listing_sort_text_page": lambda s, d: T.page(
        T.sort_listings(listings(s, d), "zona", "asc", *TIES), 2, 30
    ).select(*OUT_COLS),
    "zone_topk": lambda s, d: r4(T.top_strategic_zones(A.zone_stats(listings(s, d)))),
    "zone_topk_sales": lambda s, d: r4(T.top_zones_with_sales(A.zone_stats(listings(s, d)))),
    "competitor_topk": lambda s, d: r4(T.top_competitors(A.competitor_stats(listings(s, d)))),
    "sample_rows": lambda s, d: T.sample_rows(listings(s, d), "precio", 100, seed=7, key=F.col("link_inmueble")).select(*OUT_COLS),
    "sample_rows_portable": lambda s, d: T.sample_rows(view(s, d, "fx_inventory"), "habitaciones", 50, seed=7, key=F.col("property_id"), portable=True).select("property_id", "precio", "habitaciones"),
    "listing_page_after": lambda s, d: T.page_after(view(s, d, "fx_inventory").select("precio", "property_id", "zona"), ["precio", "property_id"], (98000.0, 113), 30),
    "positional_id": lambda s, d: H.positional_id(
        view(s, d, "fx_inventory").select("precio", "m2", "property_id"), "precio", "m2", "property_id"
    ),
}

_T = "listing_key nulls first, seq nulls first, link_inmueble nulls first, precio nulls first, metros_cuadrados nulls first, anunciante nulls first, fecha_inclusion nulls first"
ORACLE = {
    "kpi_market": f"""with {ZEROED} select count(*) as total_properties, count(*) filter (where {V}) as total_sales,
      count(*) filter (where {R}) as total_rentals, {_r(_mean('precio', V))} as avg_price_sale, {_r(_mean('precio', R))} as avg_price_rent,
      {_r(_mean('pm2', V))} as avg_price_m2_sale, {_r(_mean('pm2', R))} as avg_price_m2_rent,
      {_r(_mean('metros_cuadrados', V))} as avg_size_sale from z""",
    "kpi_market_missing_excluded": f"""with z as (select *, case when metros_cuadrados > 0 then precio / metros_cuadrados end as pm2 from fx_listings)
      select count(*) as total_properties, count(*) filter (where {V}) as total_sales,
      count(*) filter (where {R}) as total_rentals, {_r(_mean('precio', V))} as avg_price_sale, {_r(_mean('precio', R))} as avg_price_rent,
      {_r(_mean('pm2', V))} as avg_price_m2_sale, {_r(_mean('pm2', R))} as avg_price_m2_rent,
      {_r(_mean('metros_cuadrados', V))} as avg_size_sale from z""",
    "zone_stats": f"with {ZEROED}, {ZONES} select {ZONE_COLS} from zs",
    "competitor_stats": f"with {ZEROED}, {COMPETITORS} select * from cs",
    "daily_series": f"with {ZEROED}, d as ({DAYS}) select * from d order by date desc limit 30",
    "rooms_stats": f"""with {ZEROED} select habitaciones, count(*) as count, {_r('avg(precio)')} as avg_price,
      {_r('avg(metros_cuadrados)')} as avg_size, {_r(f'count(*) / (select count(*) from z where {V}) * 100.0::double')} as market_share
      from z where {V} group by 1""",
    "operation_stats": f"with {ZEROED} {_op_row('Venta')} union all {_op_row('Alquiler')}",
    "strategic_summary": f"""with {ZEROED} select count(distinct zona) filter (where strategic) as strategic_zones,
      count(*) filter (where strategic) as strategic_properties,
      {_r('count(*) filter (where strategic) / count(*) * 100.0::double')} as strategic_share,
      {_r(_mean('precio', 'strategic and ' + V))} as avg_price_strategic,
      {_r(_mean('pm2', 'strategic and ' + V))} as avg_price_m2_strategic from z""",
    "strategic_opportunities": f"""with fine as (select * replace ({FINE_ZONE} as zona) from fx_listings),
      {ZEROED.replace('from fx_listings', 'from fine')}, {ZONES} select {ZONE_COLS} from zs where is_strategic and sale_count > 0
      and sale_count < 0.15::double * (select count(*) from z where strategic and {V})
      and avg_price_m2_sale > 1.05::double * (select {_mean('pm2', V)} from z)""",
    "listing_facet_filter": _window_sql(
        "tipo_de_operacion in ('Venta', 'Alquiler') and banos = 2 and precio between 20000 and 60000 and "
        "metros_cuadrados between 40 and 180 and zona in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_7', 'NATION_11')"
    ),
    "date_window_today": _window_sql("fecha_inclusion = date '1998-06-15'"),
    "date_window_yesterday": _window_sql("fecha_inclusion = date '1998-06-14'"),
    "date_window_last7": _window_sql("fecha_inclusion >= date '1998-06-08'"),
    "date_window_last30": _window_sql("fecha_inclusion >= date '1998-05-16'"),
    "date_window_custom": _window_sql("fecha_inclusion between date '1998-03-01' and date '1998-03-20'"),
    "date_window_open_start": _window_sql("fecha_inclusion <= date '1995-02-10'"),
    "quality_gate": _window_sql("habitaciones > 0 and precio > 0 and metros_cuadrados > 0"),
    "strategic_zone_filter": _window_sql(STRATEGIC),
    "exclude_agencies": _window_sql(
        "upper(anunciante) <> 'SUPPLIER#000000003' and not contains(upper(anunciante), '#00000001') "
        "and not contains(upper(anunciante), 'E#00000002')"
    ),
    "facet_zones": "select distinct zona as value from fx_listings where zona is not null",
    "facet_advertisers": "select distinct anunciante as value from fx_listings where anunciante is not null",
    "facet_operations": "select distinct tipo_de_operacion as value from fx_listings",
    "value_counts": "select trim(zona) as value, count(*) as count from fx_listings where zona is not null group by 1",
    "value_counts_explode": "select trim(v) as value, count(*) as count from (select unnest(string_split(link_inmueble, '/')) as v from fx_listings) group by 1",
    "location_freq": "select v as location, count(*) as count from (select unnest([zona, anunciante]) as v from fx_listings) group by 1",
    "listing_sort_page": f"select {OUT} from fx_listings order by coalesce(precio, 0) desc, {_T} limit 30 offset 60",
    "listing_sort_text_page": f"select {OUT} from fx_listings order by lower(zona), {_T} limit 30 offset 30",
    "zone_topk": f"with {ZEROED}, {ZONES} select {ZONE_COLS} from (select * from zs where is_strategic order by count desc, zona limit 8)",
    "zone_topk_sales": f"with {ZEROED}, {ZONES} select {ZONE_COLS} from (select * from zs order by count desc, zona limit 8) where sale_count > 0",
    "competitor_topk": f"with {ZEROED}, {COMPETITORS} select * from cs order by count desc, anunciante limit 6",
    "sample_rows_portable": """select property_id, precio, habitaciones from fx_inventory where habitaciones is not null
        order by md5(property_id::varchar || '|7'), property_id limit 50""",
    "listing_page_after": """select precio, property_id, zona from fx_inventory where precio > 98000 or (precio = 98000 and property_id > 113)
        order by precio, property_id limit 30""",
    "positional_id": "select row_number() over (order by precio, m2, property_id) as id, precio, m2, property_id from fx_inventory",
}
ORACLE = {k: with_views(v) for k, v in ORACLE.items()}
