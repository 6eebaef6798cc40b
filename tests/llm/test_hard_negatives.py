"""Hard negatives against plain Python numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_engine.llm import hard_negatives
from tests.oracle import compare, duck

SCHEMA = "vec_id long, label int, embedding array<double>, block long, score double"


def plain(rows, positives=5, negatives=5):
    own = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, label, vector) in enumerate(own):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v)), i, other) for j, (i, other, v) in enumerate(own) if j != k and len(v) == len(vector)]
        for score, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score)[:negatives]
            out += [(a, p, rank, n, -score, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 7, 0.5) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    centre = [[rnd.gauss(0, 1) for _ in range(9)] for _ in range(6)]
    rows = [(i, rnd.randrange(4), [x + rnd.gauss(0, 0.4) for x in rnd.choice(centre)]) for i in range(600)]
    rows += [(900, 1, rows[0][2]), (900, 1, rows[0][2]), (901, 2, rows[0][2]), rows[100], rows[200]]
    rows += [(None, 1, rows[1][2]), (1000, None, rows[1][2]), (1100, 1, None), (1200, 1, [None] * 9), (1300, 1, [math.nan] * 9), (1400, 1, [math.inf] * 9)]
    return rows + [(1500, 1, [0.0] * 9), (1600, 1, []), (1601, 1, []), (1602, 2, []), (1700, 2, [3.5, -90.0]), (1701, 2, [4.0, -80.0]), (1702, 0, [3.0, -85.0]), (-100, 3, rows[2][2])]


@pytest.mark.parametrize("small", [False, True])
def test_pairs(spark, monkeypatch, rows, small):
    """Ties, repeated rows, rows that take no part, other lengths; many blocks and slots."""
    if small:
        for name, n in (("BLOCK", 60), ("SLOT", 3), ("CELL", 2), ("SLICE", 2)):
            monkeypatch.setattr(hard_negatives, name, n)
    got = found(spark, rows)
    assert got == plain(rows) and got


def test_exact_scores():
    rnd = np.random.default_rng(2)
    for reach in (3, 1 << 14, 1 << 21):
        a, b = (rnd.integers(-reach, reach + 1, (n, 700)) for n in (5, 8))
        primes = hard_negatives.primes_for(int(reach) ** 2 * 700)
        assert (hard_negatives.exact_scores(a.astype(np.int32), b.astype(np.int32), primes) == a @ b.T).all()
    ends = np.array([[-(1 << 21)] * 4, [1 << 21] * 4], np.int32)
    assert hard_negatives.exact_scores(ends, ends, hard_negatives.primes_for(1 << 44)).tolist() == [[1 << 44, -(1 << 44)], [-(1 << 44), 1 << 44]]


def test_scores_beyond_a_long(spark):
    with pytest.raises(ValueError):
        found(spark, [(0, 1, [1e30]), (1, 1, [1e30])])


def test_empty(spark):
    assert found(spark, [(None, None, None)]) == []


def test_by_sql(spark):
    assert compare(spark, duck("sf0.01"), "op13_hard_negatives", "sf0.01")[0]
