"""The reasons query answers for every pair of a client and a listing."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from listing_engine.operators import filters as P
from listing_engine.operators.matching import expand_locations
from listing_engine.operators.skew import MOST_REPEATS, SALT, split_hot_keys
from tests.oracle import ROOT
from tests.test_matching import CFG, CLI, KIDS, LIST, data, located


def test_reasons_of_every_pair(spark):
    sf = f"{ROOT}/sf0.001"
    rows = entry.queries()["hard_filter_reasons"](spark, sf).select("client_id", "property_id")
    sizes = [spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "part")]
    assert rows.count() == rows.distinct().count() == sizes[0] * sizes[1]


def test_reasons_build_no_array_for_a_pair(spark):
    """What one side decides is worked out before the join; 300,000,000 pairs took 213 s when each pair filtered and joined arrays."""
    plan = entry.queries()["hard_filter_reasons"](spark, f"{ROOT}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan[: plan.index("Join Inner")]
    assert not any(f in pairs for f in ("filter(", "array_join(", "array_except(", "lambdafunction"))


def test_place_wishes_answer_as_location_match(spark):
    """Listings and clients without places, with wildcards, with regions and several tokens, whole texts of reasons."""
    listings, clients = data()
    l, c = spark.createDataFrame(listings, LIST), spark.createDataFrame(clients, CLI)
    h = spark.createDataFrame([(p, k) for p, ks in KIDS.items() for k in ks], "parent string, child string")
    pairs = l.withColumn("clean", P.clean_tokens("zona_tokens")).crossJoin(P.place_wishes(expand_locations(c, h)))  # a small fixture
    old = P.location_match(F.col("zona_tokens"), F.col("location_tokens"), F.col("specific_tokens"))
    new = P.meets_place(F.col("clean"))
    texts = (P.hard_filter_text(CFG, new), F.array_join(P.hard_filter_reasons(CFG, old), ","))
    for r in pairs.select(new.alias("new"), old.alias("old"), "zona_tokens", "location_tokens", texts[0].alias("a"), texts[1].alias("b")).collect():
        assert r.new == r.old == located(r.zona_tokens, r.location_tokens) and r.a == r.b


def test_long_sides_are_repeated_a_bounded_number_of_times(spark):
    """The shuffled rows grow with the input, not with the pairs; 4,000 rows a side in cells of 100 pairs were 1,600,000 rows each."""
    one = lambda name: spark.range(4000).select(F.col("id").alias(name), F.lit("a").alias("token"))
    left, right = split_hot_keys(one("x"), one("y"), ["token"], F.col("x"), F.col("y"), 100, 10_000)
    assert left.count() <= MOST_REPEATS * 4000 and right.count() <= MOST_REPEATS * 4000
    assert left.join(right, ["token", *SALT]).count() == 4000 * 4000
