"""Running totals, positions, pages by key and balanced markup."""

import random

import pytest
from pyspark.sql import functions as F

from listing_engine.functions import html as M
from listing_engine.functions.text import decode_entities
from listing_engine.operators.ordering import page_after, running_total
from listing_engine.operators.shaping import positional_id


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    return [(i, rnd.choice("abc"), rnd.randint(0, 5)) for i in range(500)]


def test_running_total(spark, rows):
    df = spark.createDataFrame(rows, "id int, k string, n int").repartition(7)
    got = {r.id: r.total for r in running_total(df, F.col("n"), "k", "id").collect()}
    total, want = 0, {}
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        total += n
        want[i] = total
    assert got == want
    assert running_total(df.limit(0), F.col("n"), "k").count() == 0


def test_positions(spark, rows):
    df = spark.createDataFrame(rows, "id int, k string, n int").repartition(5)
    got = positional_id(df, "k", "n", "id", name="pos")
    assert got.columns == ["pos", "id", "k", "n"]
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert {r.pos: r.id for r in got.collect()} == {i: r[0] for i, r in enumerate(order, 1)}


def test_pages_by_key(spark, rows, tmp_path):
    spark.createDataFrame(rows, "id int, k string, n int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    seen, last = [], None
    while page := page_after(df, ["k", "id"], last, 70).collect():
        seen += [(r.k, r.id) for r in page]
        last = seen[-1]
    assert seen == sorted((k, i) for i, k, _ in rows)
    plan = page_after(df, ["k", "id"], last, 70)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,c)" in plan and "GlobalLimit" not in plan.replace("CollectLimit", "")


HTML = {
    '<div class="p"><div>Busca</div> <span>x</span></div><div class="p">no</div>': '<div class="p"><div>Busca</div> <span>x</span></div>',
    'a<DIV id="1" class="q p">b<p>c</p></DIV >d': '<DIV id="1" class="q p">b<p>c</p></DIV >',
    '<div class="p">open <div>in</div>': '<div class="p">open <div>in</div>',
    '<div class="other"></div>': "",
    None: "",
}


def test_outer_element(spark):
    df = spark.createDataFrame([(k,) for k in HTML], "h string")
    assert {r.h: r.o for r in df.select("h", M.outer_element(F.col("h"), "div", r"\bp\b").alias("o")).collect()} == HTML


def test_entities(spark):
    texts = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "&amp;eacute;&eacute;": "&eacute;é", "&lt;&nbsp;&gt;": "< >", "&#233;&#xE9;&amp;": "éé&", "&nope; & &": "&nope; & &", "5&euro;": "5€", None: None}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.o for r in df.select("t", decode_entities(F.col("t")).alias("o")).collect()} == texts
