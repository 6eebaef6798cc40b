"""Unification, dedupe, snapshot and contact-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.operators import dedupe as D
from listing_engine.operators import joins as J
from listing_engine.operators import shaping as H
from listing_engine.operators import aggregates as A
from listing_engine.operators.filters import unmapped_zones
from listing_engine.plans import snapshot as N
from listing_engine.session import scratch_folder
from workload.fixtures import sql, view, with_views

ORDER = ("source_rank", "seq", "listing_key", "precio", "metros_cuadrados", "anunciante", "fecha_inclusion")
OUT = "link_inmueble, seq, listing_key, precio, metros_cuadrados, anunciante, zona, tipo_de_operacion, fecha_inclusion"
OUT_COLS = OUT.split(", ")

# the same listing seen by up to three sources
SOURCES = """select *, cast(seq % 3 as int) as source_rank from fx_listings"""

# stored yesterday / listed today / parsed today, cut out of the line items by key
PREV = "select listing_key as id_inmueble, max(precio) as precio, max(zona) as zona from fx_listings where listing_key % 7 <> 3 group by 1"
TODAY_IDS = "select distinct listing_key as id_inmueble from fx_listings where listing_key % 5 <> 1"
NEW_ROWS = "select listing_key as id_inmueble, max(precio) + 1 as precio, max(zona) as zona from fx_listings where listing_key % 5 <> 1 and (listing_key % 7 = 3 or listing_key % 11 = 0) group by 1"

CONTACTS_PREV = """select cast(c_custkey as varchar(20)) as id, c_name as nombre, c_mktsegment as telefono, 'old@mail.example' as mail,
   cast('2024-01-01' as date) as fecha_inclusion, 'antes' as creado_info,
   case when c_custkey % 4 = 0 then '  ' when c_custkey % 4 = 1 then null else concat('pref ', c_name) end as pref_text
   from {customer} where c_custkey % 3 <> 0"""
CONTACTS_LISTED = "select cast(c_custkey as varchar(20)) as id from {customer} where c_custkey % 5 <> 2"
CONTACTS_BASE = """select cast(c_custkey as varchar(20)) as id, concat(c_name, ' new') as nombre, '600' as telefono, 'new@mail.example' as mail,
   case when c_custkey % 2 = 0 then cast('2024-02-02' as date) end as fecha_inclusion, 'ahora' as creado_info
   from {customer} where c_custkey % 5 <> 2 and c_custkey % 13 <> 0"""
CONTACTS_TEXT = "select cast(c_custkey as varchar(20)) as id, concat('texto ', c_name) as pref_text from {customer} where c_custkey % 17 <> 0"
# every page on which a contact was seen
CONTACT_PAGES = """select cast(o_custkey as varchar(20)) as id, o_orderkey as page_no, o_orderstatus as nombre, o_totalprice as amount
   from {orders}"""


def _over_listings(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text.replace("fx_listings", "{fx_listings}"), fx_listings=view(spark, sf, "fx_listings"))


def _plain(text: str) -> str:
    return text.replace("{", "").replace("}", "")


def dedupe_first_link(s, d):
    rows = _over_listings(s, d, SOURCES)
    rows = rows.withColumn("link_inmueble", F.concat(F.lit(" "), F.regexp_replace("link_inmueble", "/[0-9]+/d$", "/d")))
    return D.keep_first_link(rows, *ORDER).select(*OUT_COLS)


def dedupe_last_id(s, d):
    rows = _over_listings(s, d, SOURCES)
    return D.keep_last(rows, "listing_key", "fecha_inclusion", "precio", "seq", "metros_cuadrados", "anunciante", "link_inmueble").select(*OUT_COLS)


def _snapshot(s, d):
    return N.refresh_snapshot(
        _over_listings(s, d, PREV), _over_listings(s, d, TODAY_IDS), _over_listings(s, d, NEW_ROWS)
    )


def _contacts(mode):
    def run(s, d):
        prev, listed = sql(s, d, CONTACTS_PREV), sql(s, d, CONTACTS_LISTED)
        base, texts = sql(s, d, CONTACTS_BASE), sql(s, d, CONTACTS_TEXT)
        return N.upsert_contacts(prev, listed, base, texts, mode, "2024-03-03")

    return run


def _contacts_sql(mode: str) -> str:
    ctes = ", ".join(
        f"{n} as ({_plain(t)})"
        for n, t in (("prev", CONTACTS_PREV), ("listed", CONTACTS_LISTED), ("base", CONTACTS_BASE), ("texts", CONTACTS_TEXT))
    )
    target = {
        "all": "select id from listed",
        "new": "select id from listed where id not in (select id from prev)",
        "missing": "select id from listed where id not in (select id from prev where trim(coalesce(pref_text, '')) <> '')",
    }[mode]
    rows = """select t.id, b.nombre, b.telefono, b.mail, coalesce(b.fecha_inclusion, date '2024-03-03') as fecha_inclusion,
        b.creado_info, coalesce(x.pref_text, '') as pref_text from target t left join base b on b.id = t.id left join texts x on x.id = t.id"""
    kept = "" if mode == "all" else " union all select * from prev where id not in (select id from target)"
    return f"with {ctes}, target as ({target}) {rows}{kept}"


def ordered_unique_union(s, d):
    a = sql(s, d, "select cast(l_partkey as varchar(20)) as id, min(l_orderkey) as pos from {lineitem} where l_returnflag = 'N' group by 1")
    b = sql(s, d, "select cast(l_partkey as varchar(20)) as id, min(l_orderkey) as pos from {lineitem} where l_returnflag <> 'N' group by 1")
    return D.ordered_unique_union(a, b)


def dedupe_array_value(s, d):
    rows = sql(s, d, "select doc_id, split(lower(text), ' ') as words, n_chars from {documents}")
    return D.keep_first_array(rows, "words", "doc_id").select("doc_id", F.array_join("words", " ").alias("words"))


def zone_outer_coverage(s, d):
    base = view(s, d, "fx_listings")
    zone = lambda cond, expr: base.filter(cond).select(F.expr(expr).alias("zona_std"))
    return J.zone_coverage(
        zone("tipo_de_operacion = 'Venta'", "case when banos = 1 then null else zona end"),
        zone("tipo_de_operacion = 'Alquiler'", "concat(zona, ' ', banos)"),
        zone("tipo_de_operacion = 'Otro'", "case when habitaciones = 2 then null when habitaciones = 3 then concat(zona, ' 2') else zona end"),
    )


def unmapped(s, d):
    known = sql(s, d, "select n_name as zona from {nation} where n_nationkey % 2 = 0")
    rows = view(s, d, "fx_listings").withColumn("zona", F.expr("case when banos = 3 then null else zona end"))
    return unmapped_zones(rows, known, "zona").select("listing_key", "seq", "precio", "tipo_de_operacion")


def snapshot_before(s, d):
    snaps = sql(s, d, "select cast(o_orderdate as date) as snapshot_date, o_orderkey, o_totalprice from {orders}")
    return N.latest_before(snaps, "1997-06-15")


def contact_latest(s, d):
    return N.latest_base(sql(s, d, CONTACT_PAGES), "id", "page_no", "amount")


def target_missing(s, d):
    return D.target_ids(sql(s, d, CONTACTS_LISTED), sql(s, d, CONTACTS_PREV), "missing")


def load_report(s, d):
    new, today = _snapshot(s, d)
    return A.load_report(new, today)


def drift_union(s, d):
    a = sql(s, d, "select l_orderkey as id, l_quantity as precio, 'x' as caracteristicas_basicas from {lineitem} where l_linenumber % 2 = 1")
    b = sql(s, d, "select l_orderkey as id, l_quantity as precio, l_tax as terraza from {lineitem} where l_linenumber % 2 = 0")
    both = D.union_reconciled(a, b)
    return D.reconcile(both, [("id", "bigint"), ("precio", "double"), ("terraza", "double"), ("lat", "double"), ("caracteristicas_basicas", "string")])


_PREV, _IDS, _NEW = PREV, TODAY_IDS, NEW_ROWS
SNAP = f"with prev as ({PREV}), ids as ({TODAY_IDS}), parsed as ({NEW_ROWS})"

QUERIES = {
    "dedupe_first_link": dedupe_first_link,
    "dedupe_last_id": dedupe_last_id,
    "dedupe_array_value": dedupe_array_value,
    "ordered_unique_union": ordered_unique_union,
    "snapshot_new_ids": lambda s, d: _snapshot(s, d)[0],
    "snapshot_today": lambda s, d: _snapshot(s, d)[1],
    "snapshot_before": snapshot_before,
    "contacts_upsert_all": _contacts("all"),
    "contacts_upsert_missing": _contacts("missing"),
    "contacts_upsert_new": _contacts("new"),
    "contacts_latest_base": contact_latest,
    "target_ids_missing": target_missing,
    "zone_outer_coverage": zone_outer_coverage,
    "unmapped_zones": unmapped,
    "load_report": load_report,
    "load_report_observed": lambda s, d: N.store_snapshot(*_snapshot(s, d), scratch_folder(s, "snapshot")),
    "column_drift_union": drift_union,
    "ids_union": lambda s, d: D.ids_union(_over_listings(s, d, TODAY_IDS), _over_listings(s, d, "select id_inmueble from (" + PREV + ")")),
    "new_by_first_key": lambda s, d: J.new_by_first_key(
        _over_listings(s, d, NEW_ROWS).withColumnRenamed("id_inmueble", "url"), _over_listings(s, d, PREV).withColumnRenamed("id_inmueble", "url")
    ),
    "property_id": lambda s, d: view(s, d, "fx_listings").select(
        "link_inmueble", H.property_id(F.col("link_inmueble"), F.col("zona"), portable=True).alias("property_id")
    ),
    "derive_operation": lambda s, d: view(s, d, "fx_listings").select(
        "link_inmueble",
        H.derive_operation("a", link=F.col("link_inmueble")).alias("from_link"),
        H.derive_operation("b", title=F.concat(F.lit("Piso en "), F.upper("tipo_de_operacion"))).alias("from_title"),
        H.derive_operation("c", value=F.expr("case when banos = 1 then 'Alquiler opción a compra' when banos = 2 then tipo_de_operacion end")).alias("from_value"),
        H.derive_operation("text", value=F.expr("case when banos = 1 then ' House SALE' when banos = 2 then 'Rental' else tipo_de_operacion end")).alias("from_text"),
    ),
    "advertiser_map": lambda s, d: view(s, d, "fx_listings").select(
        "seq", H.map_advertiser(F.expr("case seq % 4 when 0 then 'Buve' when 1 then 'Grupo ARAI' when 2 then 'Invest MSS' else anunciante end")).alias("anunciante")
    ),
    "default_nulls": lambda s, d: H.default_nulls(view(s, d, "fx_listings").withColumns({
        "anunciante": F.expr("case when banos = 1 then null else anunciante end"),
        "zona": F.expr("case when banos = 2 then '-' when banos = 3 then null else zona end")})).select(
        "seq", "habitaciones", "banos", "anunciante", "zona_label",
        F.when(F.col("precio").isNull(), F.col("precio_label")).alias("precio_unknown"),
        F.when(F.col("metros_cuadrados").isNull(), F.col("m2_label")).alias("m2_unknown")),
    "composed_location": lambda s, d: view(s, d, "fx_clients").select(
        "client_id",
        H.compose_location(F.expr("case when client_id % 3 = 0 then '' else zona_std end"), F.col("location_token"), F.lit("Alicante")).alias("localizacion"),
        H.derive_title(F.expr("case when client_id % 2 = 0 then 'REF' end"), F.col("segment"), F.expr("case when client_id % 3 = 0 then '' else zona_std end"), F.col("location_token")).alias("titulo"),
        H.surface(F.col("area_min_m2"), F.col("area_max_m2")).alias("superficie")),
}

ORACLE = {
    "dedupe_first_link": f"""select {OUT} from (select * replace (regexp_replace(link_inmueble, '/[0-9]+/d$', '/d') as link_inmueble),
        row_number() over (partition by regexp_replace(link_inmueble, '/[0-9]+/d$', '/d') order by seq % 3, seq, listing_key,
        precio nulls first, metros_cuadrados nulls first, anunciante, fecha_inclusion) as rn from fx_listings) where rn = 1""",
    "dedupe_last_id": f"""select {OUT} from (select *, row_number() over (partition by listing_key order by fecha_inclusion desc,
        precio desc nulls last, seq desc, metros_cuadrados desc, anunciante desc, link_inmueble desc) as rn from fx_listings) where rn = 1""",
    "dedupe_array_value": "select min(doc_id) as doc_id, w as words from (select doc_id, lower(text) as w from documents) group by w",
    "ordered_unique_union": """with a as (select cast(l_partkey as varchar) as id, l_orderkey as pos, case when l_returnflag = 'N' then 0 else 1 end as list_no from lineitem)
        select id, list_no, pos from (select *, row_number() over (partition by id order by list_no, pos) as rn from a) where rn = 1""",
    "snapshot_new_ids": f"{SNAP} select id_inmueble from ids where id_inmueble not in (select id_inmueble from prev)",
    "snapshot_today": f"""{SNAP} select * from parsed union all select * from prev where id_inmueble in (select id_inmueble from ids)
        and id_inmueble not in (select id_inmueble from parsed)""",
    "snapshot_before": """with s as (select cast(o_orderdate as date) as snapshot_date, o_orderkey, o_totalprice from orders)
        select * from s where snapshot_date = (select max(snapshot_date) from s where snapshot_date < date '1997-06-15')""",
    "contacts_upsert_all": _contacts_sql("all"),
    "contacts_upsert_missing": _contacts_sql("missing"),
    "contacts_upsert_new": _contacts_sql("new"),
    "contacts_latest_base": """select id, page_no, nombre, amount from (select *, row_number() over (partition by id order by page_no desc, amount desc) as rn
        from (select cast(o_custkey as varchar) as id, o_orderkey as page_no, o_orderstatus as nombre, o_totalprice as amount from orders)) where rn = 1""",
    "target_ids_missing": f"""with prev as ({_plain(CONTACTS_PREV)}), listed as ({_plain(CONTACTS_LISTED)})
        select id from listed where id not in (select id from prev where trim(coalesce(pref_text, '')) <> '')""",
    "zone_outer_coverage": """with a as (select case when banos = 1 then null else zona end as z from fx_listings where tipo_de_operacion = 'Venta'),
        b as (select concat(zona, ' ', banos) as z from fx_listings where tipo_de_operacion = 'Alquiler'),
        c as (select case when habitaciones = 2 then null when habitaciones = 3 then concat(zona, ' 2') else zona end as z from fx_listings where tipo_de_operacion = 'Otro'),
        u as (select z, 1 as k from a union all select z, 2 from b union all select z, 3 from c),
        g as (select z, count(*) filter (where k = 1) as rows_1, count(*) filter (where k = 2) as rows_2, count(*) filter (where k = 3) as rows_3 from u group by z)
        select z as zone, rows_1, rows_2, rows_3, greatest(rows_1, 1) * greatest(rows_2, 1) * greatest(rows_3, 1) as joined_rows from g""",
    "unmapped_zones": """with r as (select * replace (case when banos = 3 then null else zona end as zona) from fx_listings)
        select listing_key, seq, precio, tipo_de_operacion from r where zona is null or zona not in (select n_name from nation where n_nationkey % 2 = 0)""",
    "load_report": f"""{SNAP}, t as (select id_inmueble from parsed union select id_inmueble from prev where id_inmueble in (select id_inmueble from ids))
        select (select count(*) from ids where id_inmueble not in (select id_inmueble from prev)) as new_rows, (select count(*) from t) as today_rows""",
    "load_report_observed": f"""{SNAP}, t as (select id_inmueble from parsed union select id_inmueble from prev where id_inmueble in (select id_inmueble from ids))
        select (select count(*) from ids where id_inmueble not in (select id_inmueble from prev)) as new_rows, (select count(*) from t) as today_rows""",
    "column_drift_union": """select l_orderkey as id, l_quantity as precio, null::double as terraza, null::double as lat, 'x' as caracteristicas_basicas from lineitem where l_linenumber % 2 = 1
        union all select l_orderkey, l_quantity, l_tax, null, null from lineitem where l_linenumber % 2 = 0""",
    "ids_union": f"{SNAP} select id_inmueble from ids union select id_inmueble from prev",
    "new_by_first_key": f"{SNAP} select id_inmueble as url, precio, zona from parsed where id_inmueble not in (select id_inmueble from prev)",
    "property_id": "select link_inmueble, ('0x' || substr(md5(link_inmueble || '|' || zona), 1, 8))::bigint as property_id from fx_listings",
    "derive_operation": """select link_inmueble, case when link_inmueble like '%/comprar/%' then 'Venta' when link_inmueble like '%/alquiler/%' then 'Alquiler' else 'Otro' end as from_link,
        tipo_de_operacion as from_title, case banos when 1 then 'Alquiler' when 2 then tipo_de_operacion else 'Otro' end as from_value,
        case banos when 1 then 'Venta' when 2 then 'Alquiler' else tipo_de_operacion end as from_text from fx_listings""",
    "advertiser_map": "select seq, case seq % 4 when 0 then 'BUVE' when 1 then 'Arai' when 2 then 'INVEST MSS REAL ESTATE' else anunciante end as anunciante from fx_listings",
    "default_nulls": """select seq, coalesce(habitaciones, 0) as habitaciones, banos, case when banos = 1 then 'Particular' else anunciante end as anunciante,
        case when banos in (2, 3) then 'Desconocido' else zona end as zona_label, case when precio is null then 'A consultar' end as precio_unknown,
        cast(null as varchar) as m2_unknown from fx_listings""",
    "composed_location": """select client_id, concat_ws(', ', nullif(case when client_id % 3 = 0 then '' else zona_std end, ''), location_token, 'Alicante') as localizacion,
        case when client_id % 2 = 0 then 'REF' else trim(concat(segment, ' en ', coalesce(nullif(case when client_id % 3 = 0 then '' else zona_std end, ''), location_token, ''))) end as titulo,
        coalesce(area_min_m2, area_max_m2) as superficie from fx_clients""",
}
ORACLE = {k: with_views(v) for k, v in ORACLE.items()}
