"""Text, number, list, preference and zone queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.functions import prefs as R
from listing_engine.functions import text as X
from listing_engine.functions import zones as Z
from listing_engine.operators import filters as P
from listing_engine.operators import shaping as H
from listing_engine.plans import preferences as Q
from listing_engine.plans import unify as U
from workload.fixtures import sql, table, view, with_views

# number texts in the formats the portals use
PRICE_TEXT = """select l_orderkey, l_linenumber, l_partkey, cast(cast(l_quantity as int) as varchar(9)) as q,
   case l_linenumber when 1 then concat(cast(l_partkey as varchar(9)), '.', cast(100 + l_suppkey % 900 as varchar(9)), ',', cast(10 + l_suppkey % 90 as varchar(9)), ' €')
        when 2 then concat(cast(l_partkey as varchar(9)), ',', cast(10 + l_suppkey % 90 as varchar(9)))
        when 3 then concat('$ ', cast(l_partkey as varchar(9)), '.', cast(10 + l_suppkey % 90 as varchar(9)))
        when 4 then concat('Desde ', cast(l_partkey as varchar(9)), ' m2')
        when 5 then 'A consultar' when 6 then concat('-', cast(l_suppkey as varchar(9))) else null end as t,
   cast(l_partkey as varchar(9)) as p, cast(l_suppkey as varchar(9)) as s from {lineitem}"""


def numbers(s, d):
    t = F.col("t")
    return sql(s, d, PRICE_TEXT).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        X.to_float(t).alias("as_float"), X.to_int(t).alias("as_int"),
        (F.floor(X.locale_number(t) * 100 + 0.5) / 100).alias("locale"),
        X.digits_int(t).alias("digits"), X.digits_int(t, None).alias("digits_or_null"),
        X.first_number_int(t).alias("first_number"), X.digits_only(t).alias("digits_only"),
        (F.floor(X.spanish_number(t) * 100 + 0.5) / 100).alias("spanish"),
    )


LISTS = """select c_custkey as id, case c_custkey % 6 when 0 then concat('[''', c_mktsegment, ''', ''Piso'']')
   when 1 then concat('["', c_name, '"]') when 2 then c_mktsegment when 3 then 'null' when 4 then '5' else '' end as cell,
   concat(' ', c_mktsegment, ' ; Ático/Dúplex | ', c_mktsegment, ' ,', c_name, '  ,, ') as field,
   case c_custkey % 4 when 0 then '[''sell'', ''rent'', ''Venta'']' when 1 then 'Alquiler con opción a compra, venta' when 2 then '' else 'Traspaso' end as ops,
   case c_custkey % 4 when 0 then concat('(''', c_mktsegment, ' / Centre'', {''municipio'': ''X''})') when 1 then concat('{''municipio'': ''', c_name, ''', ''barrio'': ''Nord''}')
        when 2 then concat('"', c_name, '"') else '' end as zone_cell,
   concat('  ', upper(substr(c_mktsegment, 1, 4)), ' DE LA ', lower(c_mktsegment), ' el  Y') as phrase,
   case c_custkey % 5 when 0 then 'pisos' when 1 then 'locales' when 2 then 'Clases' when 3 then 'casas rurales' else 'chalet' end as word
   from {customer}"""
LISTS = LISTS.replace("{'", "{{'").replace("'}", "'}}")


def lists(s, d):
    df = sql(s, d, LISTS)
    join = lambda a: F.array_join(a, "|")
    return df.select(
        "id", join(X.list_literal(F.col("cell"))).alias("literal"), join(X.list_literal(F.col("cell"), "self")).alias("literal_self"),
        join(X.parse_list_field(F.col("field"))).alias("field"),
        X.token_list(X.parse_list_field(F.when(F.col("id") % 7 > 0, F.col("field")))).alias("report"),
        join(X.operation_tokens(X.preference_tokens(F.col("ops")))).alias("operations"),
        X.clean_zone(F.col("zone_cell")).alias("zone"), X.title_case(F.col("phrase")).alias("titled"),
        X.singular_es(F.col("word")).alias("singular"), join(X.plural_variants(F.lower("word"))).alias("plurals"),
    )


DATES = """select o_orderkey, concat(cast(cast(o_orderdate as date) as varchar(10)), 'T10:00:00') as iso,
   case o_orderkey % 3 when 0 then concat('Creado por X el ', substr(cast(o_orderdate as varchar(10)), 9, 2), '/', substr(cast(o_orderdate as varchar(10)), 6, 2), '/', substr(cast(o_orderdate as varchar(10)), 1, 4), ' 10:00')
        when 1 then concat('x', substr(cast(o_orderdate as varchar(10)), 1, 10)) else 'sin fecha' end as info from {orders}"""


def dates(s, d):
    return sql(s, d, DATES).select("o_orderkey", X.iso_day(F.col("iso")).alias("day"), X.date_in_text(F.col("info")).alias("found"))


TERMS = """select c_custkey as id, case c_custkey % 8 when 0 then 'Venta' when 1 then '120 m²' when 2 then 'Habitaciones' when 3 then 'reformado'
   when 4 then 'a reformar' when 5 then 'Pisos /  Áticos' when 6 then 'en construcción' else c_mktsegment end as term from {customer}"""


def terms(s, d):
    n = X.normalize_term(F.col("term"))
    return sql(s, d, TERMS).select("id", n.alias("norm"), *[X.looks_like(k, n).alias(k) for k in ("operation", "numeric", "quantity", "condition")])


def _parsed(s, d) -> DataFrame:
    return Q.with_plain_text(view(s, d, "fx_prefs"))


def pref_ranges(s, d):
    t = F.col("text__")
    r = {"rooms": R.quantity_range(t, R.ROOMS), "bath": R.quantity_range(t, R.BATHS), "living": R.quantity_range(t, R.LIVING)}
    return _parsed(s, d).select("id", *[v[e].alias(f"{n}_{e}") for n, v in r.items() for e in ("lo", "hi")])


def _two(name, make):
    return lambda s, d: _parsed(s, d).select("id", make(F.col("text__"))["lo"].alias(f"{name}_min"), make(F.col("text__"))["hi"].alias(f"{name}_max"))


def vocabulary(s, d):
    return Q.induce_vocabulary(view(s, d, "fx_prefs", spread=True))


def parsed(s, d):
    df = Q.parse_preferences(view(s, d, "fx_prefs", spread=True), vocabulary(s, d))
    lists = ("operation", "types", "conditions", "locations", "flags")
    bounds = "rooms_min rooms_max bath_min bath_max living_min living_max area_min_m2 area_max_m2 price_min_eur price_max_eur".split()
    return df.select("id", *[F.array_join(c, "|").alias(c) for c in lists], *[F.col(c).cast("bigint").alias(c) for c in bounds])


def locations_stage(s, d):
    return _parsed(s, d).select("id", F.array_join(R.locations(F.col("text__")), "|").alias("locations"))


# chains of o/en tokens of growing length
CHAINS = """select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then 'Norte o en Sur o en Este o en Oeste'
   when 2 then 'o en o en o en o' when 3 then 'o en o en o' when 4 then 'en O en O en O en O en x' when 5 then 'o en o en en o en o'
   when 6 then 'o o en o en o en o' else concat('x ', cast(l_partkey as varchar(9)), ' o en o en o y en o') end as words from {lineitem}"""

ZONE_CASES = {
    0: ("Alcoi / Santa Rosa", "Alcoi", "Santa Rosa", None, ""),
    1: ("Alcoi / Centre - Zona Alta (Zona Alta)", "Alcoi", "Centre - Zona Alta", None, "Zona Alta"),
    2: ("Alcoi / Centre - Zona Alta (Zona Alta)", "Alcoi", "Centre - Zona Alta", None, "Zona Alta"),
    3: ("Alcoi / Eixample", "Alcoi", "Eixample", None, ""),
    4: ("Alcoi / Zona Nord", "Alcoi", "Zona Nord", None, ""),
    5: ("Alcoi / Batoi / Baradello (Sargento)", "Alcoi", "Batoi", "Baradello", "Sargento"),
    6: ("Alcoi (Muro d Alcoi de Alcoi)", "Alcoi", None, None, "Muro d Alcoi de Alcoi"),
    7: ("Alcoi / El Camí", "Alcoi", "El Camí", None, ""),
    8: ("Alicante (España)", "Alicante", None, None, ""),
    9: ("Villena (El Mercado; Plaza de Toros)", "Villena", None, None, "El Mercado; Plaza de Toros"),
    10: ("San Vicente del Raspeig / Haygon - Universidad (Haygon; Universidad)", "San Vicente del Raspeig", "Haygon - Universidad", None, "Haygon; Universidad"),
    11: ("Espana", None, None, None, ""),
    13: ("Eixampel (Eixampel)", None, None, None, "Eixampel"),
    14: ("Alcoi / Gormaig (Gormaigg)", "Alcoi", None, "Gormaig", "Gormaigg"),
    15: ("L'Alqueria d'Asnar", "L'Alqueria d'Asnar", None, None, ""),
    16: ("Banyeres de Mariola", "Banyeres de Mariola", None, None, ""),
    18: ("Alcoi / Els Algars", "Alcoi", None, "Els Algars", ""),
    19: ("Alcoi / Viaducto", "Alcoi", "Viaducto", None, ""),
    20: ("- (-)", None, None, None, "-"),
    21: ("Alicante", "Alicante", None, None, ""),
    23: ("Penàguila (Benifallim)", "Penàguila", None, None, "Benifallim"),
}


def zones(s, d):
    df = U.standardize_zones(view(s, d, "fx_locations"), "texto")
    z = F.col("zona_std")
    return df.select("id", "texto", z["zona"].alias("zona"), z["municipio"].alias("municipio"), z["barrio"].alias("barrio"),
                     z["subzona"].alias("subzona"), F.array_join(z["extras"], "; ").alias("extras"))


def zone_lists(s, d):
    """Two texts per listing, standardized as an array."""
    df = view(s, d, "fx_locations").groupBy("id").agg(F.array_sort(F.collect_set("texto")).alias("textos"))
    out = U.standardize_zones(df, "textos", key="id")
    return out.select("id", F.array_join("textos", "|").alias("textos"), F.array_join(F.transform("zona_std", lambda z: z["zona"]), "|").alias("zonas"))


def _zone_sql() -> str:
    """Expected zone of each location template, written out by hand."""
    q = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    cols = []
    for i, name in enumerate(("zona", "municipio", "barrio", "subzona", "extras")):
        whens = " ".join(f"when {k} then {q(v[i])}" for k, v in ZONE_CASES.items())
        part = {"zona": "concat('Cocentaina (', p, ')')", "municipio": "'Cocentaina'", "extras": "p"}.get(name, "null")
        urb = {"zona": "concat(u, ' (', u, ')')", "extras": "u"}.get(name, "null")
        cols.append(f"case k {whens} when 12 then {part} when 17 then {urb} end as {name}")
    return f"""select id, texto, zona, municipio, barrio, subzona, extras from (select id, texto, {", ".join(cols)} from
        (select l_orderkey * 10 + l_linenumber as id, {{texto}} as texto, l_partkey % 24 as k,
        concat('Partida ', l_suppkey % 50) as p, concat('Urb. ', l_suppkey % 100) as u from lineitem))"""


#: Expected older zones of the texts of fx_locations, written by hand; texts that aren't named keep their words in title case.
OLDER_EXPECTED = {
    "Santa Rosa, Alcoy / Alcoi": "Barri Santa Rosa", "Centro - Zona Alta": "Centro - Zona Alta", "Centre - Zona Alta (Alcoi)": "Centro - Zona Alta",
    "Ensanche, Alcoy": "Barri Eixample", "Zona Norte": "Barrio Zona Nord", "Barri Batoi - Baradello - Sargento, Alcoi": "Barrio Batoi - Sargento - Baradello",
    "Muro de Alcoy": "Muro De", "Camí, Alcoy": "El Cami", "Alicante (Spain)": "Alicante",
    "Villena, El Mercado - Plaza de Toros": "Villena, El Mercado - Plaza De Toros",
    "San Vicente del Raspeig, Haygon - Universidad": "San Vicente Del Raspeig, Haygon - Universidad",
    "Gormaigg (Alcoi)": "Gormaigg", "L Alqueria d Asnar": "L Alqueria D Asnar", "Banyeres de Mariola": "Banyeres De Mariola",
    "Els Algars, Alcoi": "Els Algars,", "zona viaducto": "Viaducto", "Provincia de Alicante": "Provincia De Alicante",
    "Penàguila / Benifallim": "Penàguila - Benifallim",
}


def _older_sql() -> str:
    cases = " ".join(f"when '{text}' then '{zone}'" for text, zone in OLDER_EXPECTED.items())
    return f"select id, case texto {cases} else texto end as zona from fx_locations"


def search_tokens(s, d):
    df = U.tokens_once(view(s, d, "fx_locations"), "texto")
    return df.select("id", "texto", F.array_join(F.array_sort("tokens"), "|").alias("tokens"))


NORM = "trim(regexp_replace(replace(replace(translate(lower(strip_accents(trim({c}))), ';|/\\><', ',,,,,,'), ' ,', ','), ', ', ','), '\\s+', ' ', 'g'))"

QUERIES = {
    "normalize_text": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"), F.length(X.normalize_text(F.col("text"))).alias("chars")),
    "strip_accents": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.strip_accents(F.col("text"))).alias("digest")),
    "numbers": numbers,
    "list_fields": lists,
    "dates": dates,
    "term_classes": terms,
    "canonical_url": lambda s, d: table(s, d, "pages").select("page_id", X.canonical_url(F.col("url"), "portal.example").alias("url"),
        X.canonical_url(F.regexp_replace("url", "^https?://[^/]+/?", ""), "portal.example").alias("relative")),
    "html_spans": lambda s, d: view(s, d, "fx_prefs").select("id", F.array_join(X.html_spans(F.col("pref_text")), "|").alias("spans"),
        X.html_text(F.col("pref_text")).alias("plain"), F.size(X.unlabelled_tokens(F.col("pref_text"))).alias("words")),
    "interleaved_chain": lambda s, d: sql(s, d, CHAINS).select("l_orderkey", "l_linenumber", "l_partkey", P.interleaved_chain(F.split("words", " ")).alias("chained")),
    "pref_operation": lambda s, d: _parsed(s, d).select("id", F.array_join(R.operations(F.col("text__")), "|").alias("operation")),
    "pref_counts": pref_ranges,
    "pref_area": _two("area", R.area_range),
    "pref_price": _two("price", R.price_range),
    "pref_flags": lambda s, d: _parsed(s, d).select("id", F.array_join(R.flags(F.col("text__")), "|").alias("flags"), R.numeric_context(F.col("text__")).alias("numeric")),
    "pref_locations": locations_stage,
    "vocab_induction": vocabulary,
    "parse_preferences": parsed,
    "distinct_pref_texts": lambda s, d: Q.distinct_preference_texts(view(s, d, "fx_prefs")),
    "standardize_zone": zones,
    "standardize_zone_lists": zone_lists,
    "standardize_zone_older": lambda s, d: view(s, d, "fx_locations").select("id", Z.standardize_zone_older(F.col("texto")).alias("zona")),
    "location_tokens": search_tokens,
    "normalize_clients": lambda s, d: H.normalize_clients(
        sql(s, d, LISTS).select("id", F.col("field").alias("types"), F.col("ops").alias("operation"), F.col("cell").alias("conditions"),
            F.col("phrase").alias("nombre"), F.concat(F.col("id"), F.lit(",5")).alias("price_max_eur"), F.concat(F.col("id"), F.lit(".9")).alias("rooms_min"), F.lit("").alias("locations"), F.lit("Alcoy, Alcoi").alias("zona_std"))
        ).select("id", "nombre", "price_max_eur", "rooms_min", "area_min_m2", "operation", *[F.array_join(c, "|").alias(c) for c in ("type_tokens", "operation_tokens", "locations", "flag_tokens")]),
    "normalize_listings": lambda s, d: H.normalize_listings(
        view(s, d, "fx_listings").withColumn("anunciante", F.concat(F.lit(" Ático  "), "anunciante")).withColumn("precio", F.concat(F.col("precio").cast("decimal(18,2)"), F.lit(" "))), keep=("seq", "listing_key")
        ).select("seq", "listing_key", "habitaciones", "banos", "precio", "m2", "anunciante", "operacion", "tipo", "zona_norm"),
}

_EN = "case when id % 9 = 0 then 1 else 0 end"
_LOC = """case id % 8 when 0 then 'Centre - Zona Alta (Alcoy / Alcoi)' when 1 then 'Santa Rosa Alcoy / Alcoi' when 2 then 'Alcoy / Alcoi'
   when 3 then {eix} when 4 then concat(n, ' (', r, ')') when 5 then n when 6 then 'Batoi|Viaducto|Centro|Norte|Sud' else n end"""
_BASE = "with b as (select c_custkey as id, n_name as n, r_name as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
_NUMCTX = "id % 7 < 5"

ORACLE = {
    "normalize_text": f"select doc_id, md5({NORM.format(c='text')}) as digest, length({NORM.format(c='text')}) as chars from documents",
    "strip_accents": "select doc_id, md5(strip_accents(text)) as digest from documents",
    "numbers": """with b as (select *, l_partkey::double as pk, l_suppkey::double as sk from lineitem) select l_orderkey, l_linenumber, l_partkey,
        case l_linenumber when 2 then (l_partkey || '.' || (10 + l_suppkey % 90))::double when 6 then -sk end as as_float,
        case l_linenumber when 6 then -l_suppkey::int end as as_int,
        floor(case l_linenumber when 1 then (l_partkey::varchar || (100 + l_suppkey % 900) || '.' || (10 + l_suppkey % 90))::double when 2 then (l_partkey || '.' || (10 + l_suppkey % 90))::double
          when 3 then (l_partkey || '.' || (10 + l_suppkey % 90))::double when 4 then (l_partkey || '2')::double when 5 then 0 when 6 then -sk else 0 end * 100 + 0.5) / 100 as locale,
        case l_linenumber when 1 then (l_partkey::varchar || (100 + l_suppkey % 900) || (10 + l_suppkey % 90))::bigint when 2 then (l_partkey::varchar || (10 + l_suppkey % 90))::bigint
          when 3 then (l_partkey::varchar || (10 + l_suppkey % 90))::bigint when 4 then (l_partkey || '2')::bigint when 6 then -l_suppkey else 0 end as digits,
        case l_linenumber when 1 then (l_partkey::varchar || (100 + l_suppkey % 900) || (10 + l_suppkey % 90))::bigint when 2 then (l_partkey::varchar || (10 + l_suppkey % 90))::bigint
          when 3 then (l_partkey::varchar || (10 + l_suppkey % 90))::bigint when 4 then (l_partkey || '2')::bigint when 6 then -l_suppkey end as digits_or_null,
        case l_linenumber when 1 then (l_partkey::varchar || (100 + l_suppkey % 900))::bigint when 2 then l_partkey when 3 then (l_partkey::varchar || (10 + l_suppkey % 90))::bigint
          when 4 then l_partkey when 6 then l_suppkey end as first_number,
        case l_linenumber when 1 then (l_partkey::varchar || (100 + l_suppkey % 900) || (10 + l_suppkey % 90))::bigint when 2 then (l_partkey::varchar || (10 + l_suppkey % 90))::bigint
          when 3 then (l_partkey::varchar || (10 + l_suppkey % 90))::bigint when 4 then l_partkey when 6 then l_suppkey end as digits_only,
        floor(case l_linenumber when 1 then (l_partkey::varchar || (100 + l_suppkey % 900) || '.' || (10 + l_suppkey % 90))::double when 2 then (l_partkey || '.' || (10 + l_suppkey % 90))::double
          when 3 then (l_partkey::varchar || (10 + l_suppkey % 90))::double when 4 then (l_partkey || '2')::double when 6 then sk end * 100 + 0.5) / 100 as spanish from b""",
    "list_fields": """select c_custkey as id, case c_custkey % 6 when 0 then c_mktsegment || '|Piso' when 1 then c_name when 2 then c_mktsegment else '' end as literal,
        case c_custkey % 6 when 0 then c_mktsegment || '|Piso' when 1 then c_name when 2 then c_mktsegment when 4 then '5' else '' end as literal_self,
        lower(c_mktsegment) || '|atico|duplex|' || lower(c_name) as field,
        case when c_custkey % 7 > 0 then lower(c_mktsegment) || ', atico, duplex, ' || lower(c_name) else '-' end as report,
        case c_custkey % 4 when 0 then 'venta|alquiler' when 1 then 'alquiler|venta' when 2 then '' else 'traspaso' end as operations,
        case c_custkey % 4 when 0 then c_mktsegment || ' / Centre' when 1 then c_name || ' / Nord' when 2 then c_name else 'Desconocido' end as zone,
        upper(c_mktsegment[1]) || lower(c_mktsegment[2:4]) || ' de la ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' el y' as titled,
        case c_custkey % 5 when 0 then 'piso' when 1 then 'local' when 2 then 'Clas' when 3 then 'casas rurales' else 'chalet' end as singular,
        case c_custkey % 5 when 0 then 'pisoses|pisos' when 1 then 'locales' when 2 then 'clases' when 3 then 'casas rurales' else 'chaletes|chalets|chalet' end as plurals from customer""",
    "dates": "select o_orderkey, o_orderdate::date as day, case when o_orderkey % 3 < 2 then o_orderdate::date end as found from orders",
    "term_classes": """select c_custkey as id, t as norm, t = 'venta' as operation, t = '120 m²' as numeric, t = 'habitaciones' as quantity, t in ('reformado', 'a reformar', 'en construccion') as condition
        from (select c_custkey, case c_custkey % 8 when 0 then 'venta' when 1 then '120 m²' when 2 then 'habitaciones' when 3 then 'reformado' when 4 then 'a reformar'
        when 5 then 'pisos/aticos' when 6 then 'en construccion' else lower(c_mktsegment) end as t from customer)""",
    "canonical_url": """select page_id, rtrim('https://portal.example' || regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/') as url,
        rtrim('https://portal.example/' || regexp_replace(regexp_replace(url, '^https?://[^/]+/?', ''), '[?#].*$', ''), '/') as relative from pages""",
    "html_spans": """select id, array_to_string(regexp_extract_all(pref_text, '<span>(.*?)</span>', 1), '|') as spans, trim(regexp_replace(regexp_replace(pref_text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as plain,
        len(list_filter(string_split(trim(regexp_replace(replace(regexp_replace(pref_text, '<span>.*?</span>', '', 'g'), ',', ''), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) as words from fx_prefs""",
    "interleaved_chain": """with recursive w as (select l_orderkey, l_linenumber, l_partkey, row_number() over () as rid, string_split(lower({words}), ' ') as a from lineitem),
        f as (select rid, 0 as i, 0 as n, 'o' as expect, false as hit from w union all select f.rid, i + 1,
          case when t = 'o' then (case when expect = 'o' then n + 1 else 1 end) when t = 'en' and expect = 'en' then n else 0 end,
          case when t = 'o' then 'en' else 'o' end, hit or (t = 'o' and expect = 'o' and n + 1 > 3)
          from (select f.*, w.a[i + 1] as t, len(w.a) as len from f join w using (rid)) f where i < len)
        select l_orderkey, l_linenumber, l_partkey, bool_or(hit) as chained from f join w using (rid) group by rid, l_orderkey, l_linenumber, l_partkey""",
    "pref_operation": "select c_custkey as id, case when c_custkey % 3 = 0 then 'alquiler' when c_custkey % 11 = 0 then 'venta|alquiler' else 'venta' end as operation from customer",
    "pref_counts": """select c_custkey as id, case c_custkey % 7 when 0 then c_custkey % 4 + 1 when 1 then c_custkey % 4 + 1 when 2 then c_custkey % 3 + 1 end as rooms_lo,
        case c_custkey % 7 when 0 then c_custkey % 4 + 1 when 2 then c_custkey % 3 + 3 when 3 then c_custkey % 4 + 1 end as rooms_hi,
        case c_custkey % 7 when 3 then 2 when 4 then 1 end as bath_lo, case c_custkey % 7 when 3 then 2 when 4 then c_custkey % 3 + 1 end as bath_hi,
        case c_custkey % 7 when 4 then 1 end as living_lo, cast(null as bigint) as living_hi from customer""",
    "pref_area": """select c_custkey as id, case c_custkey % 5 when 0 then 60 + c_custkey % 90 when 1 then 40 + c_custkey % 30 when 3 then 30 + c_custkey % 30 end as area_min,
        case c_custkey % 5 when 1 then 90 + c_custkey % 80 when 2 then 100 + c_custkey % 60 when 3 then ((1 + c_custkey % 7) || '' || (100 + c_custkey % 800))::bigint end as area_max from customer""",
    "pref_price": """select c_custkey as id, case c_custkey % 4 when 1 then (50 + c_custkey % 50) * 1000 when 2 then 400 + c_custkey % 600 when 3 then 40000 + c_custkey end as price_min,
        case c_custkey % 4 when 0 then (100 + c_custkey % 900) * 1000 when 1 then (120 + c_custkey % 700) * 1000 when 3 then 90000 + c_custkey end as price_max from customer""",
    "pref_flags": f"""select c_custkey as id, concat_ws('|', case when c_custkey % 8 = 5 then 'polygon' end, case when c_custkey % 8 = 2 then 'todos_los_inmuebles' end,
        case when c_custkey % 6 = 5 then 'busca_inmueble_generico' end) as flags, c_custkey % 7 < 5 as numeric from customer""",
    "pref_locations": f"{_BASE} select id, {_LOC.format(eix=repr('Eixample (Alcoy / Alcoi)|Batoi (Alcoy / Alcoi)'))} as locations from b",
    "parse_preferences": f"""{_BASE} select id, case when id % 3 = 0 then 'alquiler' when id % 11 = 0 then 'venta|alquiler' else 'venta' end as operation,
        case when id % 8 = 2 and id % 6 = 4 then 'Habitación|Inmueble' when id % 8 = 2 then 'Inmueble|Pisos/ Apartamentos' else case id % 6 when 0 then 'Pisos/ Apartamentos' when 1 then 'Casa de montaña' when 2 then 'Pisos/ Apartamentos' when 3 then 'Local Comercial' when 4 then 'Habitación' else 'Inmueble' end end as types,
        case when id % 9 = 0 then 'reformado' else '' end as conditions, {_LOC.format(eix=repr('Eixample|Batoi'))} as locations,
        concat_ws('|', case when id % 8 = 5 then 'polygon' end, case when id % 8 = 2 then 'todos_los_inmuebles' end, case when id % 6 = 5 then 'busca_inmueble_generico' end) as flags from b""",
    "vocab_induction": "select * from (values ('type', 'Piso'), ('type', 'Casa de montaña'), ('type', 'Pisos/ Apartamentos'), ('type', 'Local Comercial'), ('type', 'Habitación'), ('type', 'Inmueble'), ('condition', 'reformado')) v(kind, term) where exists (select 1 from customer)",
    "standardize_zone_older": _older_sql(),
    "normalize_clients": """select c_custkey as id, trim(lower(phrase)) as nombre, (c_custkey || '.5')::double as price_max_eur, c_custkey::int as rooms_min, null::double as area_min_m2,
        case c_custkey % 4 when 0 then 'venta,alquiler' when 1 then 'alquiler,venta' when 2 then '' else 'traspaso' end as operation, lower(c_mktsegment) || '|atico|duplex|' || lower(c_name) as type_tokens,
        case c_custkey % 4 when 0 then 'venta|alquiler' when 1 then 'alquiler|venta' when 2 then '' else 'traspaso' end as operation_tokens, 'alcoy|alcoi' as locations, '' as flag_tokens
        from (select *, concat(upper(substr(c_mktsegment, 1, 4)), ' DE LA ', lower(c_mktsegment), ' el y') as phrase from customer)""",
    "normalize_listings": f"""select seq, listing_key, habitaciones, banos, precio, metros_cuadrados as m2, 'atico ' || lower(anunciante) as anunciante, lower(tipo_de_operacion) as operacion, '' as tipo,
        lower(zona) as zona_norm from fx_listings""",
}
from workload.fixtures import LOCATIONS  # noqa: E402

_texto = LOCATIONS[LOCATIONS.index("case l_partkey") : LOCATIONS.index("as texto")]
_words = CHAINS[CHAINS.index("case l_linenumber") : CHAINS.index("as words")]
ORACLE["parse_preferences"] = f"""select l.*, rooms_lo as rooms_min, rooms_hi as rooms_max, bath_lo as bath_min, bath_hi as bath_max, living_lo as living_min, living_hi as living_max,
    area_min as area_min_m2, area_max as area_max_m2, price_min as price_min_eur, price_max as price_max_eur from ({ORACLE["parse_preferences"]}) l
    join ({ORACLE["pref_counts"]}) using (id) join ({ORACLE["pref_area"]}) using (id) join ({ORACLE["pref_price"]}) using (id)"""
ORACLE["standardize_zone"] = _zone_sql().replace("{texto}", _texto)
ORACLE["standardize_zone_lists"] = f"""select id, coalesce(string_agg(texto, '|' order by texto), '') as textos, coalesce(string_agg(zona, '|' order by texto), '') as zonas
    from (select distinct id, texto, zona from ({ORACLE["standardize_zone"]})) group by id"""
ORACLE["distinct_pref_texts"] = r"""select id, pref_text from (select id, pref_text, row_number() over (partition by
    trim(regexp_replace(replace(regexp_replace(pref_text, '<span>.*?</span>', '', 'g'), ',', ''), '\s+', ' ', 'g')) order by id) as rn from fx_prefs) where rn = 1"""
ORACLE["interleaved_chain"] = ORACLE["interleaved_chain"].replace("{words}", _words)
ORACLE = {k: with_views(v) for k, v in ORACLE.items()}
