"""Row predicates (F1-F16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_engine.config import MatchConfig
from listing_engine.functions.text import normalize_agency, strip_accents

# Substrings that mark a zone as strategic.
STRATEGIC_MARKS = ("barr", "centro", "desconocido")
# Location tokens that accept every located listing.
WILDCARD_TOKENS = ("espana", "españa", "spain")
# Stop substrings of a location candidate.
LOCATION_STOP = ("habitacion", "baño", "salon", "m²", "€", "venta", "alquiler", "busca")
# Reason codes in the order they are tested.
REASONS = (
    "operation_mismatch",
    "location_mismatch",
    "price_above_max",
    "price_below_min",
    "rooms_below_min",
    "baths_below_min",
)
# Labels of the reason codes.
REASON_LABELS = {
    "operation_mismatch": "Operación distinta a la solicitada",
    "location_mismatch": "Sin inmuebles en las ubicaciones solicitadas",
    "price_above_max": "Precio por encima del máximo (con tolerancia)",
    "price_below_min": "Precio por debajo del mínimo (con tolerancia)",
    "rooms_below_min": "Menos habitaciones de las requeridas",
    "baths_below_min": "Menos baños de los requeridos",
    "sin_inventario": "Sin inmuebles disponibles tras filtros",
}


def _all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


# ------------------------------------------------------------------ explore
def listing_facets(
    operations: Sequence[str] = (),
    rooms: int | None = None,
    baths: int | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
    area_min: float | None = None,
    area_max: float | None = None,
    zones: Sequence[str] = (),
    advertisers: Sequence[str] = (),
) -> Column:
    """F1 predicate; an empty facet or a 0/None value is no constraint."""
    conds: list[Column] = []
    if operations:
        conds.append(F.col("tipo_de_operacion").isin(*operations))
    if rooms:
        conds.append(F.col("habitaciones") == rooms)
    if baths:
        conds.append(F.col("banos") == baths)
    if price_min:
        conds.append(F.col("precio") >= price_min)
    if price_max:
        conds.append(F.col("precio") <= price_max)
    if area_min:
        conds.append(F.col("metros_cuadrados") >= area_min)
    if area_max:
        conds.append(F.col("metros_cuadrados") <= area_max)
    if zones:
        conds.append(F.col("zona").isin(*zones))
    if advertisers:
        conds.append(F.col("anunciante").isin(*advertisers))
    return _all(conds)


def filter_listings(df: DataFrame, **facets) -> DataFrame:
    return df.filter(listing_facets(**facets))


def date_window(
    df: DataFrame,
    mode: str,
    today: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    column: str = "fecha_inclusion",
) -> DataFrame:
    """all, today, yesterday, last7days, last30days or custom (closed ends)."""
    day = F.col(column)
    ref = F.to_date(F.lit(today)) if today else F.current_date()
    if mode == "today":
        return df.filter(day == ref)
    if mode == "yesterday":
        return df.filter(day == F.date_sub(ref, 1))
    if mode in ("last7days", "last30days"):
        return df.filter(day >= F.date_sub(ref, 7 if mode == "last7days" else 30))
    if mode == "custom":
        if date_from:
            df = df.filter(day >= F.to_date(F.lit(date_from)))
        if date_to:
            df = df.filter(day <= F.to_date(F.lit(date_to)))
    return df


def search_clients(df: DataFrame, term: str) -> DataFrame:
    """substring over the client's text fields; the phone is case-sensitive."""
    if not term.strip():
        return df
    t = term.lower()
    text = lambda c: F.coalesce(F.lower(c), F.lit("")).contains(t)
    inside = lambda c: F.coalesce(F.exists(c, lambda x: text(x)), F.lit(False))
    return df.filter(
        text("nombre")
        | F.coalesce(F.col("telefono"), F.lit("")).contains(t)
        | text("mail")
        | text("zona_std")
        | inside("types")
        | inside("locations")
    )


def score_band(band: str, score: Column | None = None) -> Column:
    s = F.col("score") if score is None else score
    return {
        "high": s >= 0.8,
        "medium": (s >= 0.6) & (s < 0.8),
        "low": s < 0.6,
        "all": F.lit(True),
    }[band]


def own_agency(advertiser: Column, patterns: Sequence[str]) -> Column:
    """the advertiser's name contains one of the caller's own patterns."""
    name = F.lower(advertiser)
    out = F.lit(False)
    for p in patterns:
        out = out | name.contains(p.lower())
    return F.coalesce(out, F.lit(False))


def filter_matches(
    df: DataFrame,
    term: str = "",
    operation: str = "all",
    band: str = "all",
    owner: str = "all",
    own_patterns: Sequence[str] = (),
) -> DataFrame:
    """F4. The operation compares without case, so 'Venta' finds 'venta'."""
    conds = [score_band(band)]
    if term.strip():
        t = term.lower()
        hit = F.lit(False)
        for c in ("client_name", "zona", "anunciante", "tipo"):
            hit = hit | F.coalesce(F.lower(c), F.lit("")).contains(t)
        conds.append(hit)
    if operation != "all":
        conds.append(F.lower("operacion") == operation.lower())
    own = own_agency(F.col("anunciante"), own_patterns)
    if owner == "own":
        conds.append(own)
    elif owner == "competitor":
        conds.append(~own)
    return df.filter(_all(conds))


def exclude_agencies(
    df: DataFrame, column: str, exact: Sequence[str] = (), contains: Sequence[str] = ()
) -> DataFrame:
    """drop rows whose agency equals or contains a listed name, ignoring
    accents and case; the name lists are folded by the same expression."""
    name = normalize_agency(F.coalesce(F.col(column), F.lit("")))
    hit = F.lit(False)
    for x in exact:
        hit = hit | (name == normalize_agency(F.lit(x)))
    for x in contains:
        hit = hit | name.contains(normalize_agency(F.lit(x)))
    return df.filter(~hit)


def quality_gate(df: DataFrame) -> DataFrame:
    """F6"""
    return df.filter((F.col("habitaciones") > 0) & (F.col("precio") > 0) & (F.col("metros_cuadrados") > 0))


def complete_rows(df: DataFrame, *required: str) -> DataFrame:
    """every required column is present and not the empty string."""
    return df.filter(_all([F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0 for c in required]))


def strategic_zone(zone: Column) -> Column:
    """F14"""
    z = F.lower(zone)
    out = F.lit(False)
    for mark in STRATEGIC_MARKS:
        out = out | z.contains(mark)
    return F.coalesce(out, F.lit(False))


def unmapped_zones(df: DataFrame, known: DataFrame, column: str = "zona_std") -> DataFrame:
    """rows whose zone is not in the one-column table `known`; a NULL zone
    counts as unmapped."""
    names = known.select(F.col(known.columns[0]).alias("known__")).distinct()
    return df.join(names, F.col(column) == F.col("known__"), "left_anti")


# ------------------------------------------------------------------ text rules
def interleaved_chain(tokens: Column, max_links: int = 3, link: str = "o", joint: str = "en") -> Column:
    """more than `max_links` "o" in one alternating "o en o en o" chain.

    Any other token, or a joint repeated, breaks the chain, so the test is
    whether one unbroken "o en o .. o" run of that length occurs.
    """
    text = F.concat(F.lit(" "), F.lower(F.array_join(tokens, " ")), F.lit(" "))
    chain = f" {link}" + f" {joint} {link}" * max_links + " "
    return text.contains(chain)


def drop_noise_locations(candidates: Column) -> Column:
    """remove the polygon marker, the all-listings marker and stop words."""
    def keep(c: Column) -> Column:
        low = F.lower(c)
        bad = low.rlike("pol[ií]gono definido")
        bad = bad | (F.trim(F.regexp_replace(strip_accents(low), r"\s+", " ")) == "todos los inmuebles")
        for stop in LOCATION_STOP:
            bad = bad | low.contains(stop)
        return (F.length(c) > 0) & ~bad

    return F.filter(candidates, keep)


# ------------------------------------------------------------------ matching
def clean_tokens(tokens: Column | str) -> Column:
    """Distinct tokens that aren't empty; NULL counts as none."""
    return F.array_distinct(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.length(t) > 0))


def location_match(listing_tokens: Column, client_tokens: Column, expanded: Column | None = None) -> Column:
    """F9. `expanded` = client tokens without wildcards plus their children."""
    clean = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.length(t) > 0)
    mine, theirs = clean(client_tokens), clean(listing_tokens)
    wild = F.array(*[F.lit(w) for w in WILDCARD_TOKENS])
    specific = F.array_except(mine, wild)
    target = specific if expanded is None else expanded
    return (
        F.when(F.size(mine) == 0, True)
        .when(F.size(theirs) == 0, False)
        .when(F.size(specific) == 0, True)
        .otherwise(F.arrays_overlap(theirs, target))
    )


def place_wishes(clients: DataFrame) -> DataFrame:
    """Of clients as `expand_locations` leaves them, what `meets_place` asks of a pair."""
    own = F.filter("location_tokens", lambda t: F.length(t) > 0)
    return clients.withColumns({"any_place": F.size(own) == 0, "any_located": F.size("own_tokens") == 0})


def meets_place(listing_tokens: Column) -> Column:
    """F9 between clean tokens of a listing and `place_wishes`: the same answer as
    `location_match`, with what one side decides alone worked out before the pair."""
    one = F.array_contains("specific_tokens", F.get(listing_tokens, F.lit(0)))
    overlap = F.when(F.size(listing_tokens) == 1, one).otherwise(F.arrays_overlap(listing_tokens, F.col("specific_tokens")))
    return F.col("any_place") | ((F.size(listing_tokens) > 0) & (F.col("any_located") | overlap))


def reason_flags(cfg: MatchConfig, located: Column) -> dict[str, Column]:
    """F8: one boolean per reason; NULL on either side never rejects."""
    c = F.col
    op = c("operacion")
    no = lambda cond: F.coalesce(cond, F.lit(False))
    floor = lambda bound, tol: F.greatest(F.lit(0), bound - F.lit(tol))
    return {
        "operation_mismatch": no(
            (F.length(op) > 0) & (F.size("operation_tokens") > 0) & ~F.array_contains("operation_tokens", op)
        ),
        "location_mismatch": no(~located),
        "price_above_max": no(c("precio") > c("price_max_eur") * F.lit(cfg.price_max_factor)),
        "price_below_min": no(c("precio") < c("price_min_eur") * F.lit(cfg.price_min_factor)),
        "rooms_below_min": no(c("habitaciones") < floor(c("rooms_min"), cfg.rooms_tolerance)),
        "baths_below_min": no(c("banos") < floor(c("bath_min"), cfg.baths_tolerance)),
    }


def hard_filter(cfg: MatchConfig, located: Column) -> Column:
    """F8 as one predicate."""
    return _all([~flag for flag in reason_flags(cfg, located).values()])


def hard_filter_reasons(cfg: MatchConfig, located: Column) -> Column:
    """F8 as the array of reason codes, in test order."""
    flags = reason_flags(cfg, located)
    coded = F.array(*[F.when(flags[r], F.lit(r)) for r in REASONS])
    return F.filter(coded, lambda x: x.isNotNull())


def hard_filter_text(cfg: MatchConfig, located: Column) -> Column:
    """F8 as the reason codes in test order, joined by commas. The flags of a pair
    number one of the texts that are there, so no array is built for a pair."""
    flags = reason_flags(cfg, located)
    number = sum((F.when(flags[r], F.lit(1 << i)).otherwise(0) for i, r in enumerate(REASONS)), F.lit(0))
    texts = [",".join(r for i, r in enumerate(REASONS) if n >> i & 1) for n in range(1 << len(REASONS))]
    return F.get(F.array(*[F.lit(t) for t in texts]), number)


def min_score(df: DataFrame, cfg: MatchConfig) -> DataFrame:
    """gate after jitter."""
    return df.filter(F.col("score") >= cfg.min_score)


def audit_flags(located: Column) -> dict[str, Column]:
    """F16: NULL where the client states no location / no type."""
    return {
        "zone_match": F.when(F.size("location_tokens") > 0, located.cast("int")),
        "type_match": F.when(
            F.size("type_tokens") > 0,
            F.coalesce(F.array_contains("type_tokens", F.col("tipo")), F.lit(False)).cast("int"),
        ),
    }
