"""The pipeline's near-duplicates: families of candidates meet once."""

import random

from listing_engine.llm import confirm, near_duplicates


def test_families_meet_once(spark, monkeypatch):
    """A family of near copies with a few texts apart from it: nothing is searched bucket by bucket, and one text of each set stays."""
    monkeypatch.setattr(confirm, "_links_by_buckets", None, raising=False)
    monkeypatch.setattr(confirm, "_tested", None)  # pairs outside the cells
    rnd = random.Random(4)
    base = [f"w{rnd.random()}" for _ in range(200)]

    def turned(n):
        at = set(rnd.sample(range(200), n))
        return " ".join(f"n{rnd.random()}" if i in at else w for i, w in enumerate(base))

    texts = [turned(2) for _ in range(60)] + [turned(18) for _ in range(10)]
    sets = [frozenset(near_duplicates.shingles(t, 5)) for t in texts]
    lead = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if lead[i] != lead[j] and 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                low, high = sorted((lead[i], lead[j]))
                lead = [low if x == high else x for x in lead]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = near_duplicates.deduplicated(docs).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(lead)) and 1 < len(left) < 20
