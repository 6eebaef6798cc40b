"""Lexical search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from listing_engine.llm import lexical_search
from tests.llm.conftest import SF
from tests.oracle import compare, duck

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items):
    """(item_id, rank, doc_id, score) of plain loops over all documents."""
    words = [(i, _terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, own in words:
            tf, m = Counter(own), 10 + (90 * len(own) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, k, doc, -score) for k, (score, doc) in enumerate(sorted(scored)[:10], 1)]
    return sorted(out)


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in lexical_search.lexical_search(docs, items).collect())


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(700)]
    docs += [(i, docs[0][1]) for i in range(700, 730)] + [docs[3], docs[3], (None, docs[0][1]), (800, None), (801, ""), (802, "ÄÖ Straße 中文 a@b_c"), (803, "w2 " * 40_000)]
    items = [(i, " ".join(rnd.choices(words, k=12))) for i in range(40)]
    items += [(41, docs[0][1]), (42, None), (43, "@@ __"), (44, "nowhere to be found"), (44, "W2"), (None, "w1"), (45, "STRAßE ä 中文"), (46, "w1"), items[0]]
    return docs, items


@pytest.mark.parametrize("block", [50, 4096])
def test_ranking(spark, monkeypatch, odd, block):
    """Blocks, owners and floors don't change the ranking; ties, nulls, repeated rows."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "PART_ITEMS", 7 if block == 50 else 256)
    assert found(spark, *odd) == ranking(*odd)


def test_many_items_take_several_scans(spark, monkeypatch, odd):
    monkeypatch.setattr(lexical_search, "DICTIONARY", 120)
    assert found(spark, *odd) == ranking(*odd)


def test_empty_tables_and_clashing_names(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same text here", 3, 0.5)], "item_id long, text string, block long, score double")
    assert lexical_search.lexical_search(no_docs, items).count() == 0
    assert lexical_search.lexical_search(odd_docs, items.limit(0)).count() == 0
    rows = lexical_search.lexical_search(odd_docs, items).collect()
    assert rows and {r["item_id"] for r in rows} == {1}


def test_by_sql(spark):
    assert compare(spark, duck("sf0.01"), "op11_lexical_search", "sf0.01")[0]
    assert SF
