"""Location tokens are worked out once for each distinct text."""

from pyspark.sql import functions as F

from listing_engine.functions.zones import location_tokens
from listing_engine.plans.unify import tokens_once
from workload.files import QUERIES as FILES
from workload.texts import QUERIES
from tests.oracle import ROOT


def test_tokens_once(spark):
    rows = [(1, "Batoi - Baradello, Alcoi"), (2, None), (3, ""), (4, "Batoi - Baradello, Alcoi"), (5, "Villena")]
    df = spark.createDataFrame(rows, "id int, texto string")
    found = tokens_once(df, "texto")
    assert found.columns == ["id", "texto", "tokens"]
    plain = df.withColumn("tokens", location_tokens(F.array("texto")))
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_location_tokens_query_groups_texts(spark):
    df = QUERIES["location_tokens"](spark, f"{ROOT}/sf0.001")
    assert "Aggregate" in df._jdf.queryExecution().optimizedPlan().toString()
    plain = df.select("id", "texto", F.array_join(F.array_sort(location_tokens(F.array("texto"))), "|").alias("tokens"))
    assert df.exceptAll(plain).isEmpty() and df.count() == plain.count() == spark.read.parquet(f"{ROOT}/sf0.001/lineitem.parquet").count()


def test_unified_tokens_groups_zones(spark):
    """Tokens are made above a grouping of zones, not once a row."""
    plan = FILES["unified_tokens"](spark, f"{ROOT}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [zona" in plan and "of_zona__" in plan
