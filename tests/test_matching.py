"""Candidate join, ranking and explanation against brute force in Python."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from listing_engine.config import CAPS, RANGES, SOFTNESS, WEIGHTS, MatchConfig
from listing_engine.functions.scoring import Bounds, with_scores
from listing_engine.operators.filters import WILDCARD_TOKENS
from listing_engine.operators.matching import client_classes, listing_classes
from listing_engine.operators.skew import SALT, all_pairs, split_hot_keys
from listing_engine.plans import explain as E
from listing_engine.plans.explain import best_overall, explain_unmatched, reason_counts, unmatched_reasons
from listing_engine.operators import matching as O
from listing_engine.plans.matching import best_pairs, match_all, matched_ids, prepare_clients, scored_pairs
from tests.test_scoring import CLAMP, plain_multiplier, plain_range

CFG = MatchConfig(jitter=0.0, top_n=5)
KIDS = {"province": {"a", "b"}}
LIST = "property_id bigint, precio double, m2 double, habitaciones int, banos int, operacion string, zona_tokens array<string>"
CLI = ("client_id bigint, price_min_eur double, price_max_eur double, area_min_m2 double, area_max_m2 double, rooms_min int, rooms_max int, "
       "bath_min int, bath_max int, operation_tokens array<string>, location_tokens array<string>")  # fmt: skip


def data(n_listings=120, n_clients=60, hot=True, seed=5):
    rnd = random.Random(seed)
    opt = lambda v, p=0.2: None if rnd.random() < p else v
    places = ["a", "b", "c", "d", "x y"]
    listings = []
    for i in range(n_listings):
        toks = ["a"] if hot and i % 3 == 0 else rnd.sample(places, rnd.randint(0, 3))
        listings.append((i, opt(float(rnd.randint(40, 400) * 1000)), opt(float(rnd.randint(20, 200))), opt(rnd.randint(0, 6)), opt(rnd.randint(0, 3)),
                         rnd.choice(["venta", "venta", "alquiler", "otro", "permuta", ""]), toks))
    clients = []
    for i in range(n_clients):
        lo = opt(float(rnd.randint(40, 300) * 1000))
        locs = rnd.choice([[], ["a"], ["spain"], ["spain", "c"], ["province"], ["a", "b", "c"], ["nowhere"], [""]])
        ops = rnd.choice([["venta"], ["alquiler", "venta"], [], ["permuta"], ["foo"]])
        clients.append((i, lo, opt(None if lo is None else lo + rnd.randint(-50, 120) * 1000.0), opt(float(rnd.randint(20, 80))), opt(float(rnd.randint(60, 200))),
                        opt(rnd.randint(0, 4)), opt(rnd.randint(2, 6)), opt(rnd.randint(0, 3)), opt(rnd.randint(1, 3), 0.6), ops, locs))
    return listings, clients


def located(toks, wanted):
    wanted = {t for t in wanted if t}
    if not wanted:
        return True
    if not toks:
        return False
    own = wanted - set(WILDCARD_TOKENS)
    return not own or bool(set(toks) & (own | {k for t in own for k in KIDS.get(t, ())}))


def brute(listings, clients, policy="observed"):
    out = {}
    for c in clients:
        for p in listings:
            vals = dict(zip(("price", "area", "rooms", "baths"), p[1:5]))
            b = {n: (c[1 + 2 * i], c[2 + 2 * i]) for i, n in enumerate(RANGES)}
            ops, op = c[9], p[5]
            s = {n: min(plain_range(vals[n], *b[n], SOFTNESS[n]), CAPS[n]) for n in RANGES}
            s["operation"] = 0.985 if (not ops or op in ops) else 0.0
            w = {n: WEIGHTS[n] * plain_multiplier(*b[n]) for n in RANGES} | {"operation": WEIGHTS["operation"]}
            act = [n for n in RANGES if policy == "observed" or (b[n] != (None, None) and vals[n] is not None)]
            act += ["operation"] if op and ops else []
            if act:
                import math

                tot = sum(w[n] for n in act)
                base = math.exp(sum(w[n] / tot * math.log(max(1e-6, s[n])) for n in act))
                score = min((base * max(0.6, len(act) / 5) ** 0.7) ** 1.25, 0.982)
            else:
                score = 0.7
            reasons = set()
            if op and ops and op not in ops:
                reasons.add("operation_mismatch")
            if not located(p[6], c[10]):
                reasons.add("location_mismatch")
            if p[1] is not None and c[2] is not None and p[1] > c[2] * 1.25:
                reasons.add("price_above_max")
            if p[1] is not None and c[1] is not None and p[1] < c[1] * 0.25:
                reasons.add("price_below_min")
            if p[3] is not None and c[5] is not None and p[3] < max(0, c[5] - 1):
                reasons.add("rooms_below_min")
            if p[4] is not None and c[7] is not None and p[4] < max(0, c[7] - 1):
                reasons.add("baths_below_min")
            out[c[0], p[0]] = (round(CLAMP(score), 5), reasons, round(s["price"], 4))
    return out


@pytest.fixture(scope="module", params=["observed", "declared"])
def case(request, spark):
    listings, clients = data()
    l = spark.createDataFrame(listings, LIST).repartition(3)
    for n in ("link_inmueble", "web", "anunciante", "zona", "tipo"):
        l = l.withColumn(n, F.lit(n))
    c = spark.createDataFrame(clients, CLI).withColumns({"nombre": F.lit("n"), "operation": F.array_join("operation_tokens", ","), "type_tokens": F.array().cast("array<string>")})
    h = spark.createDataFrame([(p, k) for p, ks in KIDS.items() for k in ks], "parent string, child string")
    cfg = replace(CFG, null_policy=request.param)
    return l, c, h, cfg, brute(listings, clients, request.param)


@pytest.mark.parametrize("group_rows", [3, 200_000])
def test_pairs_and_scores(case, group_rows):
    l, c, h, cfg, want = case
    got = scored_pairs(l, c, h, replace(cfg, group_rows=group_rows), prune=False).select("client_id", "property_id", F.round("score", 5)).collect()
    ok = {k: v[0] for k, v in want.items() if not v[1]}
    assert len(got) == len(ok)  # every pair once
    assert all(abs(ok[r[0], r[1]] - r[2]) < 2e-5 for r in got)


def test_pruning_loses_no_match(case):
    l, c, h, cfg, want = case
    got = {(r[0], r[1]) for r in match_all(l, c, h, replace(cfg, top_n=None)).select("client_id", "property_id").collect()}
    assert got == {k for k, v in want.items() if not v[1] and v[0] >= 0.55}


@pytest.mark.parametrize("empty", ["precio", "m2", "habitaciones", "banos", "price", "bath"])
def test_pruning_with_an_empty_column(case, empty):
    """A column that is empty throughout decides nothing, on either side."""
    l, c, h, cfg, _ = case
    gone = lambda df: df.withColumns({n: F.lit(None).cast(t) for n, t in df.dtypes if n == empty or n.startswith(f"{empty}_m")})
    l, c = gone(l), gone(c)
    cfg = replace(cfg, top_n=None)
    every = scored_pairs(l, c, h, cfg, prune=False).filter(F.col("score") >= cfg.min_score)
    want = {(r[0], r[1]) for r in every.select("client_id", "property_id").collect()}
    assert want and {(r[0], r[1]) for r in match_all(l, c, h, cfg).select("client_id", "property_id").collect()} == want


def test_top_n(case):
    l, c, h, cfg, want = case
    rows = match_all(l, c, h, cfg).orderBy("client_id", "rank_client").collect()
    per = {}
    for r in rows:
        per.setdefault(r.client_id, []).append(r)
    for cid, rs in per.items():
        scores = sorted((v[0] for k, v in want.items() if k[0] == cid and not v[1] and v[0] >= 0.55), reverse=True)[:5]
        assert [r.rank_client for r in rs] == list(range(1, len(rs) + 1))
        assert all(abs(a - r.score) < 2e-5 for a, r in zip(scores, rs)) and len(scores) == len(rs)


def test_explanation(case):
    l, c, h, cfg, want = case
    rows = {r.client_id: r for r in explain_unmatched(l, c, h, cfg).collect()}
    codes = {}
    for cid in {k[0] for k in want}:
        mine = {k[1]: v for k, v in want.items() if k[0] == cid}
        ok = [v[0] for v in mine.values() if not v[1]]
        if ok and max(ok) >= 0.55:
            assert cid not in rows
            continue
        r = rows[cid]
        best = max(ok) if ok else max(v[0] for v in mine.values())
        assert abs(r.score - best) < 2e-5 and r.passes_filters == bool(ok)
        assert set(filter(None, r.filter_reasons.split(","))) == mine[r.prop_id][1]
        for code in ["score_below_threshold"] if ok else set().union(*(v[1] for v in mine.values())):
            codes[code] = codes.get(code, 0) + 1
    assert len(explain_unmatched(l, c, h, cfg).columns) == 37
    assert {r.reason: r.clients for r in unmatched_reasons(l, c, h, cfg).collect()} == codes


def test_reason_counts(case):
    l, c, h, cfg, want = case
    counts = {}
    for (client, _), (_, reasons, _) in want.items():
        for r in reasons:
            counts[client, r] = counts.get((client, r), 0) + 1
    assert {(r.client_id, r.reason): r.listings for r in reason_counts(l, c, h, cfg).collect()} == counts


@pytest.mark.parametrize("jitter", [0.0, 0.001, 0.05])
def test_best_overall_is_the_best_of_all_pairs(case, jitter):
    l, c, h, cfg, _ = case
    cfg = replace(cfg, jitter=jitter, group_pairs=50)
    ready = prepare_clients(c, l, h, cfg)
    every = with_scores(ready.crossJoin(l), cfg)  # a small fixture
    best = {}
    for r in every.select("client_id", "property_id", "score").collect():
        best[r[0]] = min(best.get(r[0], (9, 0)), (-r[2], r[1]))
    assert {r[0]: r[1] for r in best_overall(l, ready, cfg).collect()} == {k: v[1] for k, v in best.items()}


@pytest.mark.parametrize("sizes", [(300, 200), (1000, 3), (2, 700), (1, 1)])
def test_rectangles_of_one_heavy_key(spark, sizes):
    """All rows of both sides on one key: every pair once, no cell far beyond the budget."""
    big, small = (spark.range(n).withColumnRenamed("id", name).withColumn("token", F.lit("a")) for n, name in zip(sizes, ("x", "y")))
    left, right = split_hot_keys(big, small, ["token"], F.col("x"), F.col("y"), 500, 10_000)
    pairs = left.join(right, ["token", *SALT])
    assert pairs.count() == pairs.select("x", "y").distinct().count() == sizes[0] * sizes[1]
    largest = pairs.groupBy(*SALT).count().agg(F.max("count")).first()[0]
    assert largest <= 4 * 500  # hashing deals the rows out unevenly
    assert all_pairs(big.drop("token"), small.drop("token"), F.col("x"), F.col("y"), 500, 20).count() == sizes[0] * sizes[1]


def test_ceiling_of_a_range_of_values(spark):
    """No value of a cell scores above the cell's bound, and a cell of one value meets it."""
    rnd = random.Random(9)
    some = lambda: rnd.choice([None, float(rnd.randint(0, 60))])
    rows = []
    for _ in range(400):
        low = rnd.randint(0, 60)
        rows.append((some(), some(), float(low), float(low + rnd.choice([0, 1, 15]))))
    df = spark.createDataFrame(rows, "lo double, hi double, a double, b double")
    b = Bounds.of(F.col("lo"), F.col("hi"), 0.15)
    steps = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: b.score(F.col("a") + (F.col("b") - F.col("a")) * i / 60))
    got = df.select("a", "b", b.highest(F.col("a"), F.col("b")).alias("top"), F.array_max(steps).alias("most")).collect()
    assert all(r.top >= r.most - 1e-12 and (r.a < r.b or abs(r.top - r.most) < 1e-12) for r in got)


def test_plan(case):
    l, c, h, cfg, _ = case
    plan = match_all(l, c, h, cfg)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_hash_is_stable(spark):
    from listing_engine.functions.scoring import jitter

    df = spark.range(50).select(jitter(F.col("id"), F.col("id") * 7, 0.001).alias("a"), jitter(F.col("id"), F.col("id") * 7, 0.001).alias("b"))
    assert all(r.a == r.b and abs(r.a) <= 0.001 for r in df.collect())


@pytest.mark.parametrize("jitter, top_n", [(0.0, 3), (0.05, 3), (0.05, None)])
def test_classes_give_the_first_of_all_pairs(spark, jitter, top_n):
    """Clients with equal requirements, listings with equal values and several shared tokens: the first top_n
    of all pairs, each pair once; pairs that tie with one another or whose jitter decides are not lost."""
    listings, clients = data()
    listings = [(200 * k + x[0], *x[1:]) for k in range(3) for x in listings]
    clients = [(100 * k + x[0], *x[1:]) for k in range(2) for x in clients]
    l, c = spark.createDataFrame(listings, LIST).repartition(3), spark.createDataFrame(clients, CLI)
    h = spark.createDataFrame([(p, k) for p, ks in KIDS.items() for k in ks], "parent string, child string")
    cfg = replace(CFG, jitter=jitter, top_n=top_n, class_pairs=60)
    every = {}
    for r in scored_pairs(l, c, h, cfg, prune=False).select("client_id", "property_id", "score", "s_price").collect():
        if r.score >= cfg.min_score:
            every.setdefault(r.client_id, []).append((-r.score, -r.s_price, r.property_id))
    want = {(k, x[2], n) for k, v in every.items() for n, x in enumerate(sorted(v)[:top_n], 1)}
    got = best_pairs(l, c, h, cfg).select("client_id", "property_id", "rank_client").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_classes_meet_once(spark):
    """Equal clients and equal listings form one pair under each token, whatever their number."""
    listings, clients = data(n_listings=1, n_clients=1)
    l = spark.createDataFrame([(i, *listings[0][1:6], ["a"]) for i in range(50)], LIST)
    c = spark.createDataFrame([(i, *clients[0][1:]) for i in range(40)], CLI)
    h = spark.createDataFrame([], "parent string, child string")
    classes, members = client_classes(c)
    offered = listing_classes(l, h, CFG)
    assert classes.count() == 1 and members.count() == 40
    assert offered.groupBy("token__").count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("hoped_too_much", [False, True])
def test_first_of_many_that_only_jitter_tells_apart(spark, monkeypatch, hoped_too_much):
    """200 equal listings to a class: the first by the jitter of each pair, also where fewer than top_n
    reach the score that was hoped for; only some of them are sorted for each client."""
    l = spark.createDataFrame([(i, 100000.0 + 1000 * (i % 2), 80.0, 3, 1, "venta", ["a"]) for i in range(400)], LIST)
    asked = (90000.0, 120000.0, 60.0, 100.0, 3, 3, 1, 2, ["venta"])
    c = spark.createDataFrame([(i, *asked, ["a"] if i % 2 else []) for i in range(20)], CLI)
    h = spark.createDataFrame([], "parent string, child string")
    cfg = replace(CFG, jitter=0.001, top_n=3)
    every = {}
    for r in scored_pairs(l, c, h, cfg, prune=False).select("client_id", "property_id", "score", "s_price").collect():
        every.setdefault(r.client_id, []).append((-r.score, -r.s_price, r.property_id))
    if hoped_too_much:  # no pair gets more than the least that jitter leaves
        real = O.final_score
        monkeypatch.setattr(O, "final_score", lambda cfg: real(replace(cfg, jitter=0.0)) - cfg.jitter)
        plain = {r.property_id: (r.score, r.s_price) for r in scored_pairs(l, c.limit(1), h, replace(cfg, jitter=0.0), prune=False).collect()}
        every = {k: [(-plain[p][0], -plain[p][1], p) for p in plain] for k in every}
    want = {(k, x[2], n) for k, v in every.items() for n, x in enumerate(sorted(v)[:3], 1)}
    assert {tuple(r) for r in best_pairs(l, c, h, cfg).select("client_id", "property_id", "rank_client").collect()} == want


def test_matched_clients_are_those_with_matches(case):
    l, c, h, cfg, _ = case
    cfg = replace(cfg, jitter=0.05)  # decides for some clients whether they have one
    got = [r[0] for r in matched_ids(l, c, h, cfg).collect()]
    want = {r[0] for r in scored_pairs(l, c, h, cfg, prune=False).filter(F.col("score") >= cfg.min_score).select("client_id").distinct().collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_named_columns_spare_the_other_joins(case):
    l, c, h, cfg, _ = case
    some = match_all(l, c, h, cfg, ("client_id", "property_id", "score"))
    assert "link_inmueble" not in some._jdf.queryExecution().optimizedPlan().toString()
    whole = match_all(l, c, h, cfg).select("client_id", "property_id", "score")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("jitter", [0.0, 0.001])
def test_equal_clients_meet_the_cells_once(spark, monkeypatch, jitter):
    """40 clients who ask for the same are bounded once a cell, and each gets its own best listing."""
    listings, clients = data(n_clients=1)
    l = spark.createDataFrame(listings, LIST)
    c = spark.createDataFrame([(i, *clients[0][1:]) for i in range(40)], CLI)
    cfg = replace(CFG, jitter=jitter)
    ready = prepare_clients(c, l, spark.createDataFrame([], "parent string, child string"), cfg)
    sizes, real = [], E._bounded
    monkeypatch.setattr(E, "_bounded", lambda pairs, cfg: sizes.append(pairs.count()) or real(pairs, cfg))
    got = {r[0]: r[1] for r in best_overall(l, ready, cfg).collect()}
    best = {}
    for r in with_scores(ready.crossJoin(l), cfg).select("client_id", "property_id", "score").collect():  # a small fixture
        best[r[0]] = min(best.get(r[0], (9, 0)), (-r[2], r[1]))
    assert got == {k: v[1] for k, v in best.items()} and max(sizes) <= len(listings)


def test_all_pairs_deal_each_client_out_once_a_place(case):
    """Where every passing pair is asked for, a client has one row a place and operation, not one for each band of price as well."""
    _, c, h, cfg, _ = case
    side = O.client_side(O.expand_locations(c, h), cfg, False, banded=False)
    assert side.groupBy("client_id", "token__", "op__").count().agg(F.max("count")).first()[0] == 1
    assert side.count() < O.client_side(O.expand_locations(c, h), cfg, False).count()
