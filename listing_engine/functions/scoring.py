"""Pair scoring as Column expressions.

Everything that depends on the client alone (ordered bounds, pads, effective
weights) is computed once per client before the join; what remains per pair is
plain arithmetic inside one codegen stage.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_engine.config import EPS, RANGES, MatchConfig

# Shape of the range score.
EDGE_REL, EDGE_PENALTY = 0.20, 0.22
CENTER_REL, CENTER_PENALTY = 0.25, 0.06
RANGE_CEILING = 0.995
TINY = 1e-9


def clamp01(c: Column) -> Column:
    """[0,1]; NULL and NaN become 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def binary_equality(a: Column, b: Column) -> Column:
    """1 when equal, 0 otherwise; an empty right side accepts anything."""
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    return F.when(empty(b), 1.0).when(empty(a), 0.0).when(a == b, 1.0).otherwise(0.0)


#: fields of a component's client factors
FACTORS = ("lo", "hi", "pad", "band", "mid", "center_band", "center_penalty", "ceiling", "missing", "bounded", "w")


@dataclass(frozen=True)
class Bounds:
    """Ordered bounds of one component and what derives from them.

    Open ends are infinite and nothing is NULL, which keeps the per-pair
    arithmetic free of null checks and the generated code small.
    """

    lo: Column
    hi: Column
    pad: Column
    band: Column
    mid: Column
    center_band: Column
    center_penalty: Column
    ceiling: Column
    missing: Column
    bounded: Column
    w: Column

    @staticmethod
    def of(vmin: Column, vmax: Column, softness: float, weight: float = 1.0) -> "Bounds":
        vmin, vmax = vmin.cast("double"), vmax.cast("double")
        inf = F.lit(float("inf"))
        two = vmin.isNotNull() & vmax.isNotNull()
        bounded = vmin.isNotNull() | vmax.isNotNull()
        lo = F.coalesce(F.when(two, F.least(vmin, vmax)).otherwise(vmin), -inf)
        hi = F.coalesce(F.when(two, F.greatest(vmin, vmax)).otherwise(vmax), inf)
        width = F.when(two, hi - lo).otherwise(1.0)
        base = F.when(width > 0, width).otherwise(1.0)
        return Bounds(
            lo=lo,
            hi=hi,
            pad=F.greatest(F.lit(softness) * base, F.lit(TINY)),
            band=F.greatest(F.lit(EDGE_REL) * F.greatest(width, F.lit(TINY)), F.lit(TINY)),
            mid=F.when(two, F.lit(0.5) * (lo + hi)).otherwise(inf),
            center_band=F.greatest(F.lit(CENTER_REL) * F.greatest(width, F.lit(TINY)), F.lit(TINY)),
            center_penalty=F.when(two, CENTER_PENALTY).when(bounded, 0.5 * CENTER_PENALTY).otherwise(0.0),
            ceiling=F.when(bounded, RANGE_CEILING).otherwise(1.0),
            missing=F.when(bounded, 0.0).otherwise(1.0),
            bounded=bounded,
            w=F.coalesce(F.lit(weight) * constraint_multiplier(vmin, vmax), F.lit(0.0)),
        )

    def highest(self, low: Column, high: Column) -> Column:
        """Upper bound of `score` over the values low .. high (NULL: no value at all).

        The score jumps at its bounds: a value just outside of one scores nearly
        1, one just inside less. So the part outside on either side and the part
        inside are bounded by themselves; inside it rises towards the middle, or
        away from the only bound.
        """
        low, high = low.cast("double"), high.cast("double")
        falls = lambda distance: F.greatest(F.lit(0.0), F.lit(1.0) - distance / self.pad)
        below = F.when(low < self.lo, falls(self.lo - F.least(high, self.lo))).otherwise(0.0)
        above = F.when(high > self.hi, falls(F.greatest(low, self.hi) - self.hi)).otherwise(0.0)
        inf = float("inf")
        peak = F.when(self.mid < inf, self.mid).when(self.hi < inf, low).otherwise(high)
        at = F.least(F.greatest(peak, low, self.lo), high, self.hi)
        inside = F.when((low <= self.hi) & (high >= self.lo), self.score(at)).otherwise(0.0)
        return F.when(low.isNull(), self.missing).otherwise(F.greatest(below, above, inside))

    def packed(self) -> Column:
        return F.struct(*[getattr(self, f).alias(f) for f in FACTORS])

    @staticmethod
    def stored(name: str) -> "Bounds":
        return Bounds(**{f: F.col(f"{name}__f")[f] for f in FACTORS})

    def score(self, value: Column) -> Column:
        v = F.coalesce(value.cast("double"), F.lit(0.0))
        out = F.greatest(self.lo - v, v - self.hi)  # > 0 outside; its negative is the room inside
        edge = F.lit(1.0) - F.lit(EDGE_PENALTY) * (F.lit(1.0) - F.least(F.lit(1.0), -out / self.band))
        near = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(v - self.mid) / self.center_band)
        center = F.lit(1.0) - self.center_penalty * (F.lit(1.0) - near)
        return (
            F.when(value.isNull(), self.missing)
            .when(out > 0, F.greatest(F.lit(0.0), F.lit(1.0) - out / self.pad))
            .otherwise(F.least(edge * center, self.ceiling))
        )


def score_range(value: Column, vmin: Column, vmax: Column, softness: float = 0.25) -> Column:
    """Range score in [0, 0.995], 1.0 when the client states no bound."""
    return Bounds.of(vmin, vmax, softness).score(value)


def constraint_multiplier(vmin: Column, vmax: Column) -> Column:
    """How informative a range is: 0.4 none, 0.5 one-sided, 0.5..1 by relative width."""
    lo, hi = vmin.cast("double"), vmax.cast("double")
    width, center = F.abs(hi - lo), F.abs(F.lit(0.5) * (hi + lo))
    rel = clamp01(width / F.greatest(F.lit(1.0), center))
    return (
        F.when(lo.isNull() & hi.isNull(), 0.4)
        .when(lo.isNull() | hi.isNull(), 0.5)
        .otherwise(F.lit(1.0) - F.lit(0.5) * rel)
    )


def stable_hash(cid: Column, pid: Column, kind: str) -> Column:
    """Non-negative hash of a (client, listing) pair, equal in every process."""
    if kind == "md5":
        key = F.concat_ws("|", cid.cast("string"), pid.cast("string"))
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.pmod(F.xxhash64(cid.cast("string"), pid.cast("string")), F.lit(2**31 - 1))


def jitter(cid: Column, pid: Column, amplitude: float, kind: str = "xxhash64") -> Column:
    """Deterministic tie breaker in [-amplitude, amplitude]."""
    h = F.pmod(stable_hash(cid, pid, kind), F.lit(1009)).cast("double")
    return F.lit(amplitude) * (h / F.lit(1008.0) * F.lit(2.0) - F.lit(1.0))


def with_client_factors(clients: DataFrame, listings: DataFrame, cfg: MatchConfig, population: DataFrame | None = None) -> DataFrame:
    """Add one struct per component with the factors the scorer needs.

    Under the "observed" policy a component whose column is empty on either
    side weighs nothing; that is settled here, on the small side. `population`:
    all clients, where `clients` are only some of them."""
    observed = cfg.null_policy == "observed"
    if observed:
        clients = clients.withColumn("present__", column_presence(clients if population is None else population, listings))
    cols: dict[str, Column] = {}
    for name, (_, lo, hi) in RANGES.items():
        b = Bounds.of(F.col(lo), F.col(hi), cfg.softness[name], cfg.weights[name])
        if observed:
            b = replace(b, w=F.when(F.col("present__")[name], b.w).otherwise(0.0))
        cols[f"{name}__f"] = b.packed()
    return clients.withColumns(cols).drop("present__")


def column_presence(clients: DataFrame, listings: DataFrame) -> Column:
    """Per component: does any client state a bound and any listing a value?

    Two one-row aggregates, used as scalar subqueries.
    """
    used_c = [c for _, lo, hi in RANGES.values() for c in (lo, hi)]
    used_l = [v for v, _, _ in RANGES.values()]
    stated = clients.agg(F.struct(*[(F.count(c) > 0).alias(c) for c in used_c]).alias("s")).scalar()
    filled = listings.agg(F.struct(*[(F.count(c) > 0).alias(c) for c in used_l]).alias("s")).scalar()
    return F.struct(
        *[((stated[lo] | stated[hi]) & filled[value]).alias(name) for name, (value, lo, hi) in RANGES.items()]
    )


def component_columns(cfg: MatchConfig) -> dict[str, Column]:
    """Capped component scores of a joined pair, as s_price .. s_operation."""
    out = {
        f"s_{name}": F.least(Bounds.stored(name).score(F.col(value)), F.lit(cfg.caps[name]))
        for name, (value, _, _) in RANGES.items()
    }
    fits = F.coalesce(F.array_contains("operation_tokens", F.col("operacion")), F.lit(False))
    fits = fits | (F.size("operation_tokens") == 0)
    out["s_operation"] = F.when(fits, F.lit(min(1.0, cfg.caps["operation"]))).otherwise(0.0)
    return out


def effective_weights(cfg: MatchConfig) -> dict[str, Column]:
    """Weight of each component for this pair, 0 where it takes no part."""
    out: dict[str, Column] = {}
    for name, (value, _, _) in RANGES.items():
        if cfg.weights[name] <= 0:
            continue
        b = Bounds.stored(name)
        on = b.bounded & F.col(value).isNotNull()
        out[name] = F.when(on, b.w).otherwise(0.0) if cfg.null_policy == "declared" else b.w
    if cfg.weights["operation"] > 0:
        on = F.coalesce(F.length("operacion") > 0, F.lit(False)) & (F.size("operation_tokens") > 0)
        out["operation"] = F.when(on, F.lit(cfg.weights["operation"])).otherwise(0.0)
    return out


def combined_score(cfg: MatchConfig, names: list[str]) -> Column:
    """Weighted geometric mean of s_* under weights e_*, whose sum is e_total,
    with coverage, gamma and cap (no jitter). NULL when nothing takes part."""
    weighted = [F.col(f"e_{n}") * F.ln(F.greatest(F.lit(EPS), F.col(f"s_{n}"))) for n in names]
    active = [F.when(F.col(f"e_{n}") > 0, 1.0).otherwise(0.0) for n in names]
    total = F.nullif(F.col("e_total"), F.lit(0.0))
    share = sum(active[1:], active[0]) / F.lit(float(max(1, len(names))))
    coverage = F.greatest(F.lit(cfg.coverage_min), F.least(F.lit(1.0), share))
    base = F.exp(sum(weighted[1:], weighted[0]) / total)
    raw = F.pow(base * F.pow(coverage, F.lit(cfg.coverage_gamma)), F.lit(cfg.score_gamma))
    return F.when(F.col("e_total") > 0, F.least(raw, F.lit(cfg.hard_cap)))


def _rounded(c: Column, digits: int, cfg: MatchConfig) -> Column:
    if cfg.rounding == "scaled":
        return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)
    return F.round(c, digits)


def computed(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-element generator. A later filter on them then
    reads the computed values; through a plain projection Catalyst would copy
    the whole scoring expression into the filter and evaluate it twice."""
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.inline(F.array(row)).alias(*cols))


def with_raw_scores(pairs: DataFrame, cfg: MatchConfig, components: dict[str, Column] | None = None, keep: bool = False) -> DataFrame:
    """Add s_* and `score__raw`, both not rounded and without jitter (NULL when nothing takes part), to joined
    pairs, whose factors are dropped unless `keep`. `components` replaces the component scores, for instance by their upper bounds."""
    weights = effective_weights(cfg)
    first = (components or component_columns(cfg)) | {f"e_{n}": w for n, w in weights.items()}
    staged = computed(pairs, first)
    total = sum((F.col(f"e_{n}") for n in weights), F.lit(0.0))
    raw = combined_score(cfg, list(weights))
    spent = [] if keep else [f"{n}__f" for n in RANGES]
    staged = computed(staged.drop(*spent).withColumn("e_total", total), {"score__raw": raw})
    return staged.drop("e_total", *[f"e_{n}" for n in weights])


def final_score(cfg: MatchConfig, client_id: str = "client_id", property_id: str = "property_id") -> Column:
    """The score of `score__raw`: jitter of the pair, limits, 6 decimals."""
    moved = F.col("score__raw")
    if cfg.jitter:
        moved = moved + jitter(F.col(client_id), F.col(property_id), cfg.jitter, cfg.jitter_hash)
    return _rounded(F.when(F.col("score__raw").isNull(), F.lit(cfg.neutral_score)).otherwise(clamp01(moved)), 6, cfg)


def rounded_components(df: DataFrame, cfg: MatchConfig) -> dict[str, Column]:
    return {c: _rounded(F.col(c), 4, cfg) for c in df.columns if c.startswith("s_")}


def with_scores(
    pairs: DataFrame,
    cfg: MatchConfig,
    client_id: str = "client_id",
    property_id: str = "property_id",
    components: dict[str, Column] | None = None,
    keep: bool = False,
) -> DataFrame:
    """Add s_* (4 decimals) and score (6 decimals) to joined pairs.

    `components` replaces the component scores, for instance by their upper
    bounds; the score is monotone in each of them."""
    staged = with_raw_scores(pairs, cfg, components, keep)
    staged = computed(staged, {"score": final_score(cfg, client_id, property_id)})
    return staged.withColumns(rounded_components(staged, cfg)).drop("score__raw")
