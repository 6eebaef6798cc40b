"""MinHash near-duplicates against all pairs."""

import math
import random
import re

import numpy as np
import pytest

from listing_engine.llm import confirm, minhash
from tests.oracle import compare, duck


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def brute(docs):
    """{(doc_id, n, component)} by all pairs of distinct texts."""
    sets = [shingles(t) for _, t in docs]
    lead = list(range(len(docs)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                lead[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def found(spark, docs):
    rows = minhash.minhash_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def _turned(rnd, words, n):
    at = set(rnd.sample(range(len(words)), n))
    return [f"n{rnd.random()}" if i in at else w for i, w in enumerate(words)]


@pytest.mark.parametrize("part", [5, 4096])
def test_components(spark, monkeypatch, part):
    """Links around the limit, a large family of which some pairs link and some don't, short texts, split buckets."""
    monkeypatch.setattr(confirm, "PART_MEMBERS", 2000 if part == 5 else 1 << 20)
    monkeypatch.setattr(confirm, "TILE_MEMBERS", 3000 if part == 5 else 1 << 20)
    monkeypatch.setattr(confirm.cells_of, "__defaults__", (part,))
    rnd = random.Random(3)
    texts = []
    for k in range(60):
        base = [f"{k}.{rnd.randint(0, 400)}" for _ in range(rnd.choice((3, 20, 120, 300)))]
        texts += [base, _turned(rnd, base, len(base) * rnd.randint(0, 7) // 100), base[: len(base) * rnd.randint(75, 95) // 100]]
    family = [f"f{rnd.randint(0, 900)}" for _ in range(300)]
    texts += [_turned(rnd, family, rnd.randint(4, 22)) for _ in range(70)]
    docs = [(3 * i, " ".join(t)) for i, t in enumerate(texts)]
    docs += [(1, None), (2, ""), (4, " \t"), (5, "One"), (7, "one"), (7, "other words here"), (8, "Other WORDS here"), (None, docs[0][1]), (None, "only without an id"), docs[6], (10, "x " * 50_000)]
    assert found(spark, docs) == brute(docs)


def test_sets_are_exact():
    rnd = random.Random(5)
    texts = ["", "a", "a b", " a\tb\na b ", "\x1fa\x00b c　d  ", *(" ".join(rnd.choices("abcdef", k=rnd.randint(1, 60))) for _ in range(200))]
    assert [len(s) for s in minhash.shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_posterior_by_integration():
    """The least numbers of equal values against a plain numeric posterior."""
    s = (np.arange(1_000_000) + 0.5) / 1_000_000
    for m, k in zip(range(minhash.BATCH, minhash.VALUES + 1, minhash.BATCH), minhash.least_equal()):
        tail = [float((s**x * (1 - s) ** (m - x))[s >= 0.8].sum() / (s**x * (1 - s) ** (m - x)).sum()) for x in (k - 1, k)]
        assert tail[0] <= minhash.PRUNE * 1.01 and tail[1] > minhash.PRUNE * 0.99
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for() <= minhash.MISS


def test_values_estimate_the_similarity():
    members = np.random.default_rng(1).integers(0, 1 << 63, 1200, dtype=np.uint64)
    _, values = minhash.signatures([np.sort(members[:1000]), np.sort(members[200:])], 2)
    assert math.isclose((values[0] == values[1]).mean(), 800 / 1200, abs_tol=0.13)


def test_odd(spark, odd_docs, no_docs):
    assert minhash.minhash_duplicates(no_docs).count() == 0
    rows = minhash.minhash_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()


def test_by_sql(spark):
    assert compare(spark, duck("sf0.01"), "op12_minhash", "sf0.01")[0]


@pytest.mark.parametrize("part, parts", [(5, 1), (5, 1000), (1024, 32)])
def test_families(spark, monkeypatch, part, parts):
    """A family of which some nodes link with few others: in one cell, in cells of two parts, and searched by buckets."""
    monkeypatch.setattr(confirm, "FAMILY_PART", part)
    monkeypatch.setattr(confirm, "FAMILY_PARTS", parts)
    if parts != 1:  # the family's cells are enough: no pair is handed on
        monkeypatch.setattr(confirm, "_tested", None)
    rnd = random.Random(7)
    base = [f"f{rnd.randint(0, 900)}" for _ in range(200)]
    texts = [_turned(rnd, base, rnd.randint(2, 30)) for _ in range(90)]
    texts += [_turned(rnd, t, 3) for t in texts[:20]] + [[f"{k}.{rnd.randint(0, 99)}" for _ in range(20)] for k in range(20)]
    texts += [_turned(rnd, t, 1) for t in texts[-10:]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark, docs) == brute(docs)
