"""Golden cases of zones, preferences, text helpers and file sources."""

import pytest
from pyspark.sql import functions as F

from listing_engine.functions import prefs as R
from listing_engine.functions import text as X
from listing_engine.functions import zones as Z
from listing_engine.plans import snapshot as N
from listing_engine.plans.preferences import distinct_preference_texts, parse_preferences
from listing_engine.plans.unify import standardize_zones
from listing_engine.sources import files as L

ZONES = {
    "Muro": "Alcoi (Muro d'Alcoi)",
    "el cami": None,
    "norte": "San Vicente del Raspeig / Norte",
    "Ensanche, Alcoy (barri)": "Alcoi / Eixample (Barri)",
    "eixamplee": "Alcoi / Eixample (Eixamplee)",
    "Gormaigg (Alcoi)": "Alcoi / Gormaig (Gormaigg)",
    "España": "Espana",
    "Alicante (Spain)": "Alicante (España)",
    "-": "- (-)",
}


def test_zones(spark):
    got = {r.x: r.zona_std for r in standardize_zones(spark.createDataFrame([(z,) for z in ZONES] + [(None,)], "x string"), "x").collect()}
    for text, zona in ZONES.items():
        if zona:
            assert got[text].zona == zona, text
    assert got["el cami"].municipio is None and got["el cami"].extras == ["El el Cami"]
    assert got[None] is None


def test_fuzzy_is_not_edit_distance(spark):
    # one swap: 2 edits of 8, ratio 0.875, below the limit
    df = standardize_zones(spark.createDataFrame([("Eixampel",), ("beniatta",)], "x string"), "x")
    got = {r.x: r.zona_std for r in df.collect()}
    assert got["Eixampel"].municipio is None and got["beniatta"].subzona == "Beniata"


def test_location_tokens(spark):
    df = spark.createDataFrame([("Centre - Zona Alta (Alcoy)",), ("Alicante (Spain)",)], "x string")
    a, b = [set(r[0]) for r in df.select(Z.location_tokens(F.array("x"))).collect()]
    assert {"centre", "zona alta", "alcoy", "alcoi"} <= a and {"alacant", "espana", "spain", "alicante"} <= b
    kids = {r.child for r in Z.default_hierarchy(spark).filter("parent = 'alacant'").collect()}
    assert {"alcoi", "cocentaina"} <= kids


PREFS = {
    "Busca Piso , para Venta , desde 120 m² , con 4 Habitaciones , hasta 130000 € , en Centre - Zona Alta , Alcoy / Alcoi , Todos los inmuebles": ["Centre - Zona Alta (Alcoy / Alcoi)"],
    "Busca Piso para Venta en Centre - Zona Alta Alcoy / Alcoi , todos los inmuebles": ["Centre - Zona Alta Alcoy / Alcoi"],
    "Busca Inmueble para Venta en Alcoy / Alcoi, Todos los inmuebles": ["Alcoy / Alcoi"],
    "Busca casa en Batoi , Alcoy / Alcoi o en Muro , Muro / Alicante": ["Batoi (Alcoy / Alcoi)", "Muro (Muro / Alicante)"],
    "Busca casa": [],
}


def test_preference_locations(spark):
    df = spark.createDataFrame([(t,) for t in PREFS], "t string").withColumn("l", R.locations(F.col("t")))
    got = {r.t: r.h for r in df.select("t", R.harmonize_city(F.col("l")).alias("h")).collect()}
    assert got == PREFS


def test_harmonize(spark):
    rows = {1: ["Centre - Zona Alta (Alcoy / Alcoi)", "Eixample (Alcoy / Alcoi)"], 2: ["Batoi", "Alcoy / Alcoi"], 3: ["Batoi", "Muro (Muro / Alicante)", "Alcoi / Alcoy"]}
    got = {r[0]: r[1] for r in spark.createDataFrame(list(rows.items()), "i int, a array<string>").select("i", R.harmonize_city(F.col("a"))).collect()}
    assert got == {1: ["Centre - Zona Alta", "Eixample"], 2: ["Batoi"], 3: ["Batoi (Alcoi / Alcoy)", "Muro (Muro / Alicante)"]}


def test_types(spark):
    vocab = spark.createDataFrame([("type", t) for t in ("Piso", "Casa", "Casa de montaña", "Bloque de apartamentos", "Apartamento", "Habitación", "Chalet/Torre", "Chalet")] + [("condition", "reformado")], "kind string, term string")
    texts = {
        1: "Busca <span>Bloque de apartamentos</span> para Venta",
        2: "Busca casa de montaña o piso, con 3 habitaciones",
        3: "Busca habitación, reformado",
        4: "Busca chalet/torre en Batoi",
        5: "Busca Inmueble para Alquiler",
    }
    got = {r.id: (r.types, r.conditions) for r in parse_preferences(spark.createDataFrame(list(texts.items()), "id int, pref_text string"), vocab).collect()}
    assert got[1][0] == ["Bloque de apartamentos"]
    assert got[2][0] == ["Casa de montaña", "Pisos/ Apartamentos"]
    assert got[3] == (["Habitación"], ["reformado"])
    assert got[4][0] == ["Chalet/Torre"]
    assert got[5][0] == ["Inmueble"]


def test_distinct_texts(spark):
    df = spark.createDataFrame([(1, "a <span>x</span> b"), (2, "a <span>y</span> b"), (3, "o en o en o en o")], "id int, pref_text string")
    assert [r.id for r in distinct_preference_texts(df).collect()] == [1]


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([("  Ático ; Dúplex / Nº 3 | x > y \\ z  ",), (None,)], "t string").select(X.normalize_text(F.col("t")).alias("a"))
    for r in df.select("a", X.normalize_text(F.col("a")).alias("b")).collect():
        assert r.a == r.b
    assert df.first().a == "atico,duplex,no 3,x,y,z"


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('﻿id_inmueble,precio,baños,habitaciones,titulo,fecha_inclusion\n1,"A consultar",2,3.0,"uno, ""dos""",2024-01-02T00:00\n2,1500,,x,t,\n', encoding="utf-8")
    rows = L.read_portal_csv(spark, str(path), "b").orderBy("id_inmueble").collect()
    assert (rows[0].id_inmueble, rows[0].precio, rows[0].banos, rows[0].habitaciones, rows[0].titulo) == ("1", None, 2, 3, 'uno, "dos"')
    assert rows[1].precio == 1500.0 and rows[1].habitaciones is None and rows[1].terraza is None
    path.write_bytes("id_inmueble,titulo\n1,España\n".encode("latin-1"))
    assert L.read_portal_csv(spark, str(path), "a", "ISO-8859-1").first().titulo == "España"
    with pytest.raises(ValueError):
        L.uploaded_listings(spark.createDataFrame([("1",)], "precio string"), "2024-01-01")


def test_ids_and_snapshots(spark, tmp_path):
    ids = spark.createDataFrame([("7",), (" 8 ",)], "id string")
    L.write_ids(ids, str(tmp_path / "ids"))
    assert sorted(r.id for r in L.read_ids(spark, str(tmp_path / "ids")).collect()) == ["7", "8"]
    for day, price in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02", 3)):
        L.write_snapshot(spark.createDataFrame([("a", price)], "id_inmueble string, precio int"), str(tmp_path / "snap"), day)
    snaps = L.read_snapshots(spark, str(tmp_path / "snap"))
    assert sorted(r.precio for r in snaps.collect()) == [1, 3]  # a rerun replaces its own day only
    assert N.latest_before(snaps, "2024-01-02").first().precio == 1
    L.write_unified(snaps.select("id_inmueble", "precio"), str(tmp_path / "csv"))
    assert L.read_text_csv(spark, str(tmp_path / "csv")).columns == ["id_inmueble", "precio"]


def test_facets_reach_the_scan(spark, tmp_path):
    from listing_engine.operators.filters import filter_listings

    spark.createDataFrame([(2, 1, 10.0, 50.0, "z", "ad", "Venta", "w")], "habitaciones int, banos int, precio double, metros_cuadrados double, zona string, anunciante string, tipo_de_operacion string, web string").write.parquet(str(tmp_path / "l"))
    df = filter_listings(spark.read.parquet(str(tmp_path / "l")), operations=["Venta"], price_min=5).select("precio")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tipo_de_operacion,Venta)" in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<precio:double,tipo_de_operacion" in plan and "web" not in plan


def test_nested_markup_and_entities(spark):
    from listing_engine.functions import html as M
    from listing_engine.functions.text import decode_entities
    from listing_engine.sources.pages import cut_foreign_sections

    page = (
        '<div class="a"><div>x<div>y</div></div>Piso</div><div class="b">z</div><div class="a">q</div>'
        '<section class="recommender-slider"><div><a href="f"></a></div><section>s</section>t</section>END<div data-testid="recommender"><div>k</div>bad</div>ok'
    )
    h = F.col("h")
    rows = spark.createDataFrame([(page,), (None,), ("<div class='a'>open<div>n</div>",)], "h string")
    got = rows.select(M.elements(h, "div", "a").alias("all"), M.element(h, "div", "a").alias("one"), cut_foreign_sections(h).alias("cut")).collect()
    assert got[0]["all"] == ["<div>x<div>y</div></div>Piso", "q"] and got[0]["one"] == "<div>x<div>y</div></div>Piso" and got[0]["cut"].endswith('<div class="a">q</div>ENDok')
    assert got[1]["all"] == [] and got[1]["one"] is None
    assert got[2]["one"] == "open<div>n</div>"
    text = spark.createDataFrame([("Constru&iacute;da ba&#241;o &#x20AC; &amp;lt; a&nbsp;b &bogus; &#128512; & x &",)], "h string")
    assert text.select(decode_entities(h)).first()[0] == "Construída baño € &lt; a b &bogus; 😀 & x &"


def test_odd_cells_do_not_stop_a_load(spark):
    from listing_engine.operators.dedupe import reconcile
    from listing_engine.sources.files import unified_listings

    rows = spark.createDataFrame([("600123456789", "2", "n/a"), ("3 hab", "", "2024-01-02")], "habitaciones string, banos string, fecha_inclusion string")
    assert [r["habitaciones"] for r in unified_listings(rows, "2024-05-05").collect()] == [None, 3]
    assert [r["d"] for r in reconcile(rows.withColumnRenamed("fecha_inclusion", "d"), [("d", "date")]).collect()][0] is None
