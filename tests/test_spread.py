"""Queries on small files that make much of each row use all cores, with the same rows."""

import pytest

from workload.fixtures import sql, view
from workload.portal_pages import NESTED, PAGES_A, PAGES_C, PAGES_CRM, PAGES_R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", [PAGES_A, PAGES_C, PAGES_R, PAGES_CRM, NESTED])
def test_pages_are_written_and_read_by_several_tasks(spark, text):
    pages = sql(spark, SF, text, spread=True)
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, sql(spark, SF, text).collect()))


def test_preferences_are_dealt_out(spark):
    prefs = view(spark, SF, "fx_prefs", spread=True)
    assert prefs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, prefs.collect())) == sorted(map(tuple, view(spark, SF, "fx_prefs").collect()))
