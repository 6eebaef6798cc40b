"""Why a client has no match: reasons and best candidate.

The question ranges over all listings for every unmatched client, yet nothing
here pairs everything with everything:

* reasons are decided by totals and extremes of the listings (one aggregate);
* the best candidate overall is found by branch and bound over cells of
  listings (operation, rooms, baths; then bands of price and area): cells whose
  upper bound stays below a score that is known to exist are never opened.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listing_engine.config import RANGES, MatchConfig
from listing_engine.functions.scoring import Bounds, component_columns, final_score, with_raw_scores, with_scores
from listing_engine.functions.text import token_list
from listing_engine.operators.filters import (
    REASON_LABELS,
    WILDCARD_TOKENS,
    hard_filter_reasons,
    location_match,
)
from listing_engine.operators.matching import expand_locations, price_band
from listing_engine.operators.ordering import running_total
from listing_engine.operators.skew import all_pairs
from listing_engine.plans.matching import best_pairs, matched_ids, prepare_clients
from listing_engine.session import cut_lineage

BELOW_THRESHOLD, NO_INVENTORY = "score_below_threshold", "sin_inventario"
VALUES = [v for v, _, _ in RANGES.values()]


def reason_label(code: Column, cfg: MatchConfig) -> Column:
    """P15"""
    out = code
    for reason, label in REASON_LABELS.items():
        out = F.when(code == reason, label).otherwise(out)
    return F.when(code == BELOW_THRESHOLD, F.lit(f"Coincidencias con score < {cfg.min_score}")).otherwise(out)


def best_passing(listings: DataFrame, clients: DataFrame, hierarchy: DataFrame, cfg: MatchConfig, population: DataFrame) -> DataFrame:
    """W2, first half: per client the best pair that passes the hard filters, the first listing on ties."""
    first = replace(cfg, top_n=1, min_score=0.0)
    best = best_pairs(listings, clients, hierarchy, first, prune=False, ties=(), population=population)
    return best.select("client_id", F.col("property_id").alias("ok_property"), F.col("score").alias("ok_score"))


CELL = ["operacion", "habitaciones", "banos", "no_price", "no_area"]
FINE = [*CELL, "price_band", "area_band"]


def listing_cells(listings: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The listings with the bands that, with the other fields, name their cell."""
    band = lambda c: F.coalesce(price_band(F.col(c), cfg.band_ratio), F.lit(-1))
    missing = {"no_price": F.col("precio").isNull(), "no_area": F.col("m2").isNull()}
    return listings.select("property_id", "operacion", *VALUES).withColumns({**missing, "price_band": band("precio"), "area_band": band("m2")})


def _summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell the ranges of price and area, and its first listing as a sample."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("precio", "m2") for n, f in (("lo", F.min), ("hi", F.max))]
    return cells.groupBy(*keys).agg(*ends, F.min(F.struct("property_id", "precio", "m2")).alias("sample"))


def _bounded(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs of a client and a cell with `ceiling`, an upper bound of the score of its listings,
    `even` (all of them score alike but for jitter), and `found`, the sample's own score without jitter and id."""
    plain = replace(cfg, jitter=0.0)
    price, area = Bounds.stored("price"), Bounds.stored("area")
    tops = {"price": price.highest(F.col("precio_lo"), F.col("precio_hi")), "area": area.highest(F.col("m2_lo"), F.col("m2_hi"))}
    parts = component_columns(cfg) | {f"s_{n}": F.least(top, F.lit(cfg.caps[n])) for n, top in tops.items()}
    flat = lambda b, name, c: ~b.bounded | F.col(f"{c}_lo").isNull() | (F.col(f"{c}_lo") == F.col(f"{c}_hi")) | (F.col(f"s_{name}") <= 0)
    sealed = pairs.withColumns({"precio": F.col("precio_lo"), "m2": F.col("m2_lo"), "property_id": F.col("sample.property_id")})
    topped = with_scores(sealed, plain, components=parts, keep=True).withColumnRenamed("score", "ceiling")
    even = flat(price, "price", "precio") & flat(area, "area", "m2")
    topped = topped.withColumns({"even": even, "ceiling": F.col("ceiling") + F.lit(cfg.jitter + 2e-6), "precio": F.col("sample.precio"), "m2": F.col("sample.m2")})
    topped = topped.drop(*[c for c in topped.columns if c.startswith("s_")])
    real = with_scores(topped, plain, keep=True)
    found = F.struct((-F.col("score")).alias("s"), F.col("property_id").alias("p"))
    return real.withColumn("found", found).drop("precio", "m2", "property_id", "score", *[c for c in real.columns if c.startswith("s_")])


def _open_cells(bounded: DataFrame, best: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Those cells of a class whose ceiling reaches what jitter leaves of the best score found so far."""
    least = -F.col("best.s") - F.lit(cfg.jitter)
    return bounded.join(best, "client_id").filter(F.col("ceiling") >= least).drop("best")


def best_overall(listings: DataFrame, clients: DataFrame, cfg: MatchConfig) -> DataFrame:
    """W2, second half: per client the listing with the highest score, hard filters or not, the lowest property_id on ties.

    Branch and bound over cells of listings that agree in operation, rooms and
    baths and, one level down, in bands of price and area. Every cell gives an
    upper bound of its scores and, by its first listing, a score that exists;
    only cells whose bound reaches the best existing score are opened. Cells in
    which all listings score alike need no opening, unless jitter tells them apart.

    Clients who ask for the same search once, without jitter; where jitter decides,
    the pairs within its reach of the best go on to the clients.
    """
    factors = ["operation_tokens", *[f"{n}__f" for n in RANGES]]
    wishes = clients.select("client_id", F.struct(*factors).alias("asked__"))
    named = cut_lineage(wishes.groupBy("asked__").agg(F.min("client_id").alias("class__")))
    members = wishes.join(named, "asked__").select("class__", "client_id")
    asked = named.select(F.col("class__").alias("client_id"), "asked__.*")
    placed = listing_cells(listings, cfg)
    fine = cut_lineage(_summed(placed, FINE))
    # ranges and sample of a coarse cell from its fine ones
    ends = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("precio", "m2") for n, f in (("lo", F.min), ("hi", F.max))]
    coarse = fine.groupBy(*CELL).agg(*ends, F.min("sample").alias("sample"))
    lowest = lambda df, c: df.groupBy("client_id").agg(F.min(c).alias("best"))
    seen_of = lambda *dfs: reduce(DataFrame.unionByName, [df.select("client_id", "found") for df in dfs])

    def meet(cells: DataFrame, keys: list[str], finer: DataFrame) -> DataFrame:
        """The named cells of each class, with what `finer` holds of them."""
        left, right = cells.select("client_id", *factors, *keys).alias("l"), finer.alias("r")
        pairs = left.join(right, [F.col("l." + k).eqNullSafe(F.col("r." + k)) for k in keys])
        return pairs.select("client_id", *[F.col(f"l.{c}") for c in factors], *[F.col(f"r.{c}") for c in finer.columns])

    top = all_pairs(asked, coarse, F.col("client_id"), F.xxhash64(*CELL), cfg.group_pairs, cfg.group_rows)
    top = cut_lineage(_bounded(top, cfg))
    middle = cut_lineage(_bounded(meet(_open_cells(top, lowest(top, "found"), cfg), CELL, fine), cfg))
    seen = lowest(seen_of(top, middle), "found")
    left = _open_cells(middle, seen, cfg)
    if not cfg.jitter:
        left = left.filter(~F.col("even"))
    kinds = placed.groupBy(*FINE, "precio", "m2")
    if not cfg.jitter:
        kinds = kinds.agg(F.min("property_id").alias("property_id"))
        exact = with_scores(meet(left, FINE, kinds), cfg).select("client_id", F.struct((-F.col("score")).alias("s"), F.col("property_id").alias("p")).alias("found"))
        best = lowest(exact.unionByName(seen.select("client_id", F.col("best").alias("found"))), "found")
        return members.join(best.select(F.col("client_id").alias("class__"), F.col("best.p").alias("any_property")), "class__").drop("class__")
    kinds = kinds.agg(F.collect_list("property_id").alias("members__"))
    exact = with_raw_scores(meet(left, FINE, kinds), cfg).withColumn("plain__", F.coalesce("score__raw", F.lit(cfg.neutral_score)))
    exact = exact.select(F.col("client_id").alias("class__"), "members__", "score__raw", "plain__")
    exact = exact.withColumn("most__", F.max("plain__").over(Window.partitionBy("class__"))).filter(F.col("plain__") >= F.col("most__") - (2 * cfg.jitter + 2e-6))
    pairs = exact.select("class__", "score__raw", F.explode("members__").alias("property_id")).join(members, "class__")
    found = F.struct((-final_score(cfg)).alias("s"), F.col("property_id").alias("p"))
    return lowest(pairs.select("client_id", found.alias("found")), "found").select("client_id", F.col("best.p").alias("any_property"))


def reasons_over_inventory(listings: DataFrame, clients: DataFrame, cfg: MatchConfig) -> DataFrame:
    """A16 without pairs: per client the union of the rejection reasons over
    all listings, as an array.

    Price, rooms and baths need only the extremes of the listings; operation
    and location compare how many listings fit with how many there are.
    """
    tokens = F.array_distinct(F.filter(F.coalesce("zona_tokens", F.array().cast("array<string>")), lambda t: F.length(t) > 0))
    ranged = listings.withColumn("zona_tokens", tokens)
    totals = ranged.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.length("operacion") > 0).alias("with_op"),
            F.count_if(F.size("zona_tokens") == 0).alias("no_place"),
            F.max("precio").alias("price_hi"),
            F.min("precio").alias("price_lo"),
            F.min("habitaciones").alias("rooms_lo"),
            F.min("banos").alias("baths_lo"),
        ).alias("t")
    ).scalar()

    joined = clients.join(_fitting(ranged, clients), "client_id").withColumn("t", totals)
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0))
    own = F.filter("location_tokens", lambda t: F.length(t) > 0)
    wild_only = F.size(F.array_except(own, F.array(*[F.lit(w) for w in WILDCARD_TOKENS]))) == 0
    misplaced = (
        F.when(F.size(own) == 0, False)
        .when(wild_only, c("t.no_place") > 0)
        .otherwise(zero("place_fit") < c("t.n"))
    )
    floor = lambda bound, tol: F.greatest(F.lit(0), c(bound) - F.lit(tol))
    flags = {
        "operation_mismatch": (F.size("operation_tokens") > 0) & (zero("op_fit") < c("t.with_op")),
        "location_mismatch": misplaced,
        "price_above_max": c("t.price_hi") > c("price_max_eur") * F.lit(cfg.price_max_factor),
        "price_below_min": c("t.price_lo") < c("price_min_eur") * F.lit(cfg.price_min_factor),
        "rooms_below_min": c("rooms_min").isNotNull() & (c("t.rooms_lo") < floor("rooms_min", cfg.rooms_tolerance)),
        "baths_below_min": c("bath_min").isNotNull() & (c("t.baths_lo") < floor("bath_min", cfg.baths_tolerance)),
    }
    coded = F.filter(F.array(*[F.when(F.coalesce(f, F.lit(False)), F.lit(r)) for r, f in flags.items()]), lambda x: x.isNotNull())
    reasons = F.when(F.size(coded) == 0, F.array(F.lit(NO_INVENTORY))).otherwise(coded)
    return joined.select("client_id", reasons.alias("reasons"))


def _fitting(listings: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, op_fit, place_fit: how many listings have one of the client's operations, and one of its places."""
    by_op = listings.filter(F.length("operacion") > 0).groupBy("operacion").agg(F.count(F.lit(1)).alias("n__"))
    op_fit = clients.select("client_id", F.explode("operation_tokens").alias("operacion")).join(by_op, "operacion").groupBy("client_id").agg(F.sum("n__").alias("op_fit"))
    places = listings.groupBy("zona_tokens").agg(F.count(F.lit(1)).alias("n__")).withColumn("token__", F.explode("zona_tokens"))
    shared = F.array_intersect("specific_tokens", "zona_tokens")
    place_fit = (
        clients.select("client_id", "specific_tokens", F.explode("specific_tokens").alias("token__"))
        .join(places, "token__")
        .filter(F.get(shared, F.lit(0)) == F.col("token__"))
        .groupBy("client_id")
        .agg(F.sum("n__").alias("place_fit"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return clients.join(op_fit, "client_id", "left").join(place_fit, "client_id", "left").select("client_id", zero("op_fit"), zero("place_fit"))


def reason_counts(listings: DataFrame, clients: DataFrame, hierarchy: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """F8 over the whole inventory: client_id, reason, listings (how many it rejects, 1 or more).

    No pair is formed. Operation and place compare how many listings fit with
    how many there are; price, rooms and baths are counts below a bound, read
    off one running total over the distinct values and the distinct bounds.
    """
    none = F.array().cast("array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(c, none), lambda t: F.length(t) > 0))
    ready = cut_lineage(expand_locations(clients, hierarchy))
    ranged = listings.withColumn("zona_tokens", clean("zona_tokens"))
    floor = lambda bound, tol: F.greatest(F.lit(0), F.col(bound) - F.lit(tol)).cast("double")
    # what is counted, where ties of value and bound fall (0: the bound in front), the bound
    bounds = {
        "price_above_max": ("precio", 2, F.col("price_max_eur") * F.lit(cfg.price_max_factor)),
        "price_below_min": ("precio", 0, F.col("price_min_eur") * F.lit(cfg.price_min_factor)),
        "rooms_below_min": ("habitaciones", 0, F.when(F.col("rooms_min").isNotNull(), floor("rooms_min", cfg.rooms_tolerance))),
        "baths_below_min": ("banos", 0, F.when(F.col("bath_min").isNotNull(), floor("bath_min", cfg.baths_tolerance))),
    }
    asks = F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(w).alias("what"), x.cast("double").alias("x"), F.lit(k).alias("tie")) for r, (w, k, x) in bounds.items()])
    asked = ready.select("client_id", F.explode(asks).alias("a")).select("client_id", "a.*").filter("x is not null")
    fields = F.array(*[F.struct(F.lit(w).alias("what"), F.col(w).cast("double").alias("x")) for w in ("precio", "habitaciones", "banos")])
    values = ranged.select(F.explode(fields).alias("f")).select("f.*").filter("x is not null").groupBy("what", "x").agg(F.count(F.lit(1)).alias("n"))
    points = values.select("what", "x", F.lit(1).alias("tie"), "n").unionByName(asked.select("what", "x", "tie").distinct().withColumn("n", F.lit(0).cast("bigint")))
    summed = running_total(points, F.col("n"), "what", "x", "tie", name="upto")
    sizes = values.groupBy("what").agg(F.sum("n").alias("all__"))
    before = summed.groupBy("what").agg(F.min(F.col("upto") - F.col("n")).alias("base__"))
    upto = summed.filter("tie <> 1").join(before, "what").join(sizes, "what", "left")
    upto = upto.select("what", "x", "tie", (F.col("upto") - F.col("base__")).alias("below"), F.coalesce("all__", F.lit(0)).alias("all__"))
    counted = asked.join(upto, ["what", "x", "tie"]).select("client_id", "reason", F.when(F.col("tie") == 2, F.col("all__") - F.col("below")).otherwise(F.col("below")).alias("listings"))

    totals = ranged.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.length("operacion") > 0).alias("with_op"), F.count_if(F.size("zona_tokens") == 0).alias("no_place")).alias("t")
    ).scalar()
    own = clean("location_tokens")
    wild_only = F.size(F.array_except(own, F.array(*[F.lit(w) for w in WILDCARD_TOKENS]))) == 0
    fitting = ready.join(_fitting(ranged, ready), "client_id").withColumn("t", totals)
    wrong_op = F.when(F.size("operation_tokens") > 0, F.col("t.with_op") - F.col("op_fit")).otherwise(0)
    wrong_place = F.when(F.size(own) == 0, 0).when(wild_only, F.col("t.no_place")).otherwise(F.col("t.n") - F.col("place_fit"))
    flags = F.array(*[F.struct(F.lit(r).alias("reason"), c.cast("bigint").alias("listings")) for r, c in (("operation_mismatch", wrong_op), ("location_mismatch", wrong_place))])
    named = fitting.select("client_id", F.inline(flags))
    return counted.unionByName(named).filter("listings > 0")


def unmatched_status(
    listings: DataFrame, clients: DataFrame, hierarchy: DataFrame, cfg: MatchConfig, matches: DataFrame | None = None
) -> DataFrame:
    """The clients without a match, with their best passing pair if any.

    Who is matched comes from `matches`, else from the pruned pairs, which
    leave out what cannot be a match anyway. Only the clients that remain are
    paired without pruning.
    """
    ready = prepare_clients(clients, listings, hierarchy, cfg)
    if matches is None:
        matches = matched_ids(listings, clients, hierarchy, cfg)
    open_clients = cut_lineage(ready.join(matches.select("client_id").distinct(), "client_id", "left_anti"))
    return cut_lineage(open_clients.join(best_passing(listings, open_clients, hierarchy, cfg, clients), "client_id", "left"))


def explain_unmatched(
    listings: DataFrame, clients: DataFrame, hierarchy: DataFrame, cfg: MatchConfig = MatchConfig(), matches: DataFrame | None = None
) -> DataFrame:
    """I5 + P12: the 37-column report, one row per unmatched client."""
    status = unmatched_status(listings, clients, hierarchy, cfg, matches)
    stuck = status.filter(F.col("ok_property").isNull())
    chosen = (
        status.join(best_overall(listings, stuck, cfg), "client_id", "left")
        .withColumn("candidate_source", F.when(F.col("ok_property").isNotNull(), "passes_filters").otherwise("best_overall"))
        .withColumn("property_id", F.coalesce("ok_property", "any_property"))
        .drop("ok_property", "ok_score", "any_property")
    )
    pairs = chosen.join(listings, "property_id")
    located = location_match(F.col("zona_tokens"), F.col("location_tokens"), F.col("specific_tokens"))
    scored = with_scores(pairs, cfg).withColumn("reasons__", F.sort_array(hard_filter_reasons(cfg, located)))
    return unmatched_report(scored, cfg)


def unmatched_report(best: DataFrame, cfg: MatchConfig) -> DataFrame:
    """P12 over scored candidate pairs with `reasons__`."""
    c = F.col
    prop = {
        "prop_id": "property_id", "prop_link": "link_inmueble", "prop_web": "web", "prop_anunciante": "anunciante",
        "prop_operacion": "operacion", "prop_tipo": "tipo", "prop_zona": "zona", "prop_precio": "precio",
        "prop_m2": "m2", "prop_habitaciones": "habitaciones", "prop_banos": "banos",
    }
    client = (
        "price_min_eur price_max_eur area_min_m2 area_max_m2 rooms_min rooms_max bath_min bath_max"
    ).split()
    tokens = lambda name: token_list(c(name)) if name in best.columns else F.lit("-")
    return best.select(
        "client_id",
        c("nombre").alias("client_name"),
        "candidate_source",
        (F.size("reasons__") == 0).alias("passes_filters"),
        *["score", "s_price", "s_area", "s_rooms", "s_baths", "s_operation"],
        *[c(src).alias(name) for name, src in prop.items()],
        tokens("zona_tokens").alias("prop_zona_tokens"),
        F.lit("-").alias("prop_flag_tokens"),
        F.array_join("reasons__", ",").alias("filter_reasons"),
        F.array_join(F.transform("reasons__", lambda r: reason_label(r, cfg)), "; ").alias("filter_reason_labels"),
        c("operation").alias("client_operation"),
        *[c(n).alias(f"client_{n}") for n in client],
        tokens("location_tokens").alias("client_location_tokens"),
        tokens("type_tokens").alias("client_type_tokens"),
        tokens("cond_tokens").alias("client_cond_tokens"),
    )


def unmatched_reasons(
    listings: DataFrame, clients: DataFrame, hierarchy: DataFrame, cfg: MatchConfig = MatchConfig(), matches: DataFrame | None = None
) -> DataFrame:
    """Clients per reason and their share of the unmatched ones."""
    status = unmatched_status(listings, clients, hierarchy, cfg, matches)
    stuck = status.filter(F.col("ok_property").isNull())
    coded = status.filter(F.col("ok_property").isNotNull()).select(
        "client_id", F.array(F.lit(BELOW_THRESHOLD)).alias("reasons")
    ).unionByName(reasons_over_inventory(listings, stuck, cfg))
    per_reason = coded.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("clients"))
    total = coded.agg(F.count(F.lit(1))).scalar()
    return per_reason.select(
        "reason", reason_label(F.col("reason"), cfg).alias("label"), "clients", (F.col("clients") / total * 100).alias("pct")
    )
