"""Market, competitor, match and text roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listing_engine.operators.filters import own_agency, strategic_zone

SALE, RENT = "Venta", "Alquiler"
# Display order of the operations.
OPERATION_ORDER = ("Venta", "Alquiler", "Otro")
# Thresholds of the opportunity rule.
OPPORTUNITY_SHARE, OPPORTUNITY_PREMIUM = 0.15, 1.05
HIGH_SCORE = 0.8


def _zeroed(df: DataFrame, missing_as_zero: bool) -> DataFrame:
    """Missing numbers count as 0 by default, as they do once a CSV is loaded."""
    if not missing_as_zero:
        return df
    zero = {"precio": 0.0, "metros_cuadrados": 0.0, "habitaciones": 0, "banos": 0}
    return df.fillna({k: v for k, v in zero.items() if k in df.columns})


def _is(op: str) -> Column:
    return F.col("tipo_de_operacion") == op


def _price_per_m2() -> Column:
    return F.when(F.col("metros_cuadrados") > 0, F.col("precio") / F.col("metros_cuadrados"))


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _avg(value: Column | str, cond: Column) -> Column:
    return _or0(F.avg(F.when(cond, F.col(value) if isinstance(value, str) else value)))


def _pct(part: Column, total: Column) -> Column:
    return _or0(part / F.nullif(total, F.lit(0)) * 100)


def market_kpis(df: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """A1: one row."""
    return _zeroed(df, missing_as_zero).agg(
        F.count(F.lit(1)).alias("total_properties"),
        F.count_if(_is(SALE)).alias("total_sales"),
        F.count_if(_is(RENT)).alias("total_rentals"),
        _avg("precio", _is(SALE)).alias("avg_price_sale"),
        _avg("precio", _is(RENT)).alias("avg_price_rent"),
        _avg(_price_per_m2(), _is(SALE)).alias("avg_price_m2_sale"),
        _avg(_price_per_m2(), _is(RENT)).alias("avg_price_m2_rent"),
        _avg("metros_cuadrados", _is(SALE)).alias("avg_size_sale"),
    )


def zone_stats(df: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """A2: one row per zone. The totals behind the shares are summed from the
    grouped rows, whose shuffle both branches share."""
    zones = (
        _zeroed(df, missing_as_zero)
        .groupBy("zona")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if(_is(SALE)).alias("sale_count"),
            F.count_if(_is(RENT)).alias("rent_count"),
            _avg("precio", _is(SALE)).alias("avg_price_sale"),
            _avg("precio", _is(RENT)).alias("avg_price_rent"),
            _avg(_price_per_m2(), _is(SALE)).alias("avg_price_m2_sale"),
            _avg(_price_per_m2(), _is(RENT)).alias("avg_price_m2_rent"),
            F.avg("metros_cuadrados").alias("avg_size"),
            _or0(F.min(F.when(_is(SALE), F.col("precio")))).alias("min_price_sale"),
            _or0(F.max(F.when(_is(SALE), F.col("precio")))).alias("max_price_sale"),
            _or0(F.min(F.when(_is(RENT), F.col("precio")))).alias("min_price_rent"),
            _or0(F.max(F.when(_is(RENT), F.col("precio")))).alias("max_price_rent"),
        )
    )
    total = zones.agg(F.struct(F.sum("count").alias("n"), F.sum("sale_count").alias("s"), F.sum("rent_count").alias("r")).alias("t")).scalar()
    return zones.withColumns(
        {
            "market_share": _pct(F.col("count"), total["n"]),
            "sale_share": _pct(F.col("sale_count"), total["s"]),
            "rent_share": _pct(F.col("rent_count"), total["r"]),
            "is_strategic": strategic_zone(F.col("zona")),
        }
    )


def competitor_stats(df: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """A3: one row per advertiser. Rows are first reduced per (advertiser,
    zone, operation), so a dominant advertiser is combined before the shuffle
    and the distinct counts run on the reduced rows."""
    small = (
        _zeroed(df, missing_as_zero)
        .groupBy("anunciante", "zona", "tipo_de_operacion")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("precio").alias("price"),
            F.count("precio").alias("priced"),
            F.sum("metros_cuadrados").alias("size"),
            F.count("metros_cuadrados").alias("sized"),
            F.min("precio").alias("lo"),
            F.max("precio").alias("hi"),
        )
    )
    strategic = F.when(strategic_zone(F.col("zona")), F.col("zona"))
    zones = small.agg(F.count_distinct(strategic)).scalar()
    part = lambda op, c: F.sum(F.when(_is(op), F.col(c)))
    mean = lambda op: _or0(part(op, "price") / F.nullif(part(op, "priced"), F.lit(0)))
    total = small.agg(F.sum("n")).scalar()
    return (
        small.groupBy("anunciante")
        .agg(
            F.sum("n").alias("count"),
            F.coalesce(part(SALE, "n"), F.lit(0)).alias("sale_count"),
            F.coalesce(part(RENT, "n"), F.lit(0)).alias("rent_count"),
            mean(SALE).alias("avg_price_sale"),
            mean(RENT).alias("avg_price_rent"),
            (F.sum("size") / F.nullif(F.sum("sized"), F.lit(0))).alias("avg_size"),
            F.count_distinct("zona").alias("zones_count"),
            F.count_distinct(strategic).alias("strategic_zones_count"),
            F.count_distinct("tipo_de_operacion").alias("types_count"),
            F.min("lo").alias("min_price"),
            F.max("hi").alias("max_price"),
        )
        .withColumns(
            {
                "market_share": F.col("count") / total * 100,
                "strategic_presence": F.col("strategic_zones_count") / F.nullif(zones, F.lit(0)) * 100,
            }
        )
    )


def daily_series(df: DataFrame, last: int | None = 30, missing_as_zero: bool = True) -> DataFrame:
    """A4 + T3: per day present, the latest `last` days, ascending."""
    days = (
        _zeroed(df, missing_as_zero)
        .groupBy(F.col("fecha_inclusion").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if(_is(SALE)).alias("sale_count"),
            F.count_if(_is(RENT)).alias("rent_count"),
            _avg("precio", _is(SALE)).alias("avg_price_sale"),
            _avg("precio", _is(RENT)).alias("avg_price_rent"),
            _or0(F.sum(F.when(_is(SALE), F.col("precio")))).alias("total_value_sale"),
            _or0(F.sum(F.when(_is(RENT), F.col("precio")))).alias("total_value_rent"),
        )
    )
    if last:
        days = days.orderBy(F.desc("date")).limit(last)
    return days.orderBy("date")


def rooms_stats(df: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """A5: sales by number of rooms."""
    rooms = (
        _zeroed(df, missing_as_zero)
        .filter(_is(SALE))
        .groupBy("habitaciones")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("precio").alias("avg_price"), F.avg("metros_cuadrados").alias("avg_size"))
    )
    total = rooms.agg(F.sum("count")).scalar()
    return rooms.withColumn("market_share", F.col("count") / total * 100)


def operation_stats(df: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """Always one row for sales and one for rentals, from one pass."""
    def side(op: str) -> Column:
        return F.struct(
            F.lit(op).alias("tipo"),
            F.count_if(_is(op)).alias("count"),
            _avg("precio", _is(op)).alias("avg_price"),
            _avg("metros_cuadrados", _is(op)).alias("avg_size"),
            _pct(F.count_if(_is(op)), F.count(F.lit(1))).alias("market_share"),
            _or0(F.sum(F.when(_is(op), F.col("precio")))).alias("total_value"),
        )

    both = _zeroed(df, missing_as_zero).agg(F.array(side(SALE), side(RENT)).alias("r"))
    return both.select(F.inline("r"))


def strategic_summary(df: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """One row over the strategic zones."""
    strategic = strategic_zone(F.col("zona"))
    sale = strategic & _is(SALE)
    return _zeroed(df, missing_as_zero).agg(
        F.count_distinct(F.when(strategic, F.col("zona"))).alias("strategic_zones"),
        F.count_if(strategic).alias("strategic_properties"),
        _pct(F.count_if(strategic), F.count(F.lit(1))).alias("strategic_share"),
        _avg("precio", sale).alias("avg_price_strategic"),
        _avg(_price_per_m2(), sale).alias("avg_price_m2_strategic"),
    )


def strategic_opportunities(df: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """Strategic zones with few sales and a price premium."""
    base = _zeroed(df, missing_as_zero)
    sales = base.agg(F.count_if(_is(SALE) & strategic_zone(F.col("zona")))).scalar()
    market = base.agg(_avg(_price_per_m2(), _is(SALE))).scalar()
    return zone_stats(df, missing_as_zero).filter(
        F.col("is_strategic")
        & (F.col("sale_count") > 0)
        & (F.col("sale_count") < sales * F.lit(OPPORTUNITY_SHARE))
        & (F.col("avg_price_m2_sale") > market * F.lit(OPPORTUNITY_PREMIUM))
    )


# ------------------------------------------------------------------ matches
def property_match_counts(matches: DataFrame) -> DataFrame:
    """A9"""
    return matches.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= HIGH_SCORE).alias("high_quality")
    )


def client_match_groups(matches: DataFrame, own_patterns: Sequence[str]) -> DataFrame:
    """A10"""
    own = own_agency(F.col("anunciante"), own_patterns)
    return matches.groupBy("client_id", "client_name").agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count_if(F.col("score") >= HIGH_SCORE).alias("high_score_matches"),
        F.avg("score").alias("avg_score"),
        F.count_if(own).alias("own_matches"),
        F.count_if(~own).alias("competitor_matches"),
    )


def global_match_stats(matches: DataFrame, own_patterns: Sequence[str]) -> DataFrame:
    """A11, rolled up from the per-client groups, so no distinct is needed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return client_match_groups(matches, own_patterns).agg(
        total("total_matches"),
        total("high_score_matches"),
        F.count(F.lit(1)).alias("unique_clients"),
        total("own_matches"),
        total("competitor_matches"),
    )


def client_coverage(clients: DataFrame) -> DataFrame:
    """0 counts as not stated."""
    stated = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return clients.agg(
        F.count(F.lit(1)).alias("total_clients"),
        F.count_if(some("types") | stated("rooms_min") | stated("price_min_eur") | some("locations")).alias("with_requirements"),
        F.count_if(stated("price_min_eur") | stated("price_max_eur")).alias("with_budget"),
        F.count_if(some("locations")).alias("with_location"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of trimmed values; list columns are exploded first."""
    value = F.col(column)
    if df.schema[column].dataType.typeName() == "array":
        df = df.select(F.explode(column).alias(column))
    return (
        df.filter(value.isNotNull())
        .groupBy(F.trim(value.cast("string")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def location_frequency(df: DataFrame, column: str = "locations", by: str = "freq_desc") -> DataFrame:
    """Unique locations, by frequency or by name."""
    squeezed = F.trim(F.regexp_replace("loc", r"\s+", " "))
    counts = (
        df.select(F.explode(column).alias("loc"))
        .select(squeezed.alias("location"))
        .filter(F.length("location") > 0)
        .groupBy("location")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    name = F.lower("location")
    return counts.orderBy(name, "location") if by == "alpha" else counts.orderBy(F.desc("count"), name, "location")


def candidates_per_client(matches: DataFrame) -> DataFrame:
    """A15"""
    return matches.groupBy("client_id", "client_name").agg(F.count("property_id").alias("candidates"))


def matched_share(matches: DataFrame, clients: DataFrame) -> DataFrame:
    """Clients with a match and their share of all clients, one row."""
    total = clients.agg(F.count(F.lit(1))).scalar()
    return (
        matches.agg(F.count_distinct("client_id").alias("matched_clients"))
        .withColumn("total_clients", total)
        .withColumn("match_pct", _pct(F.col("matched_clients"), F.col("total_clients")))
    )


QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
QUANTILE_NAMES = ("min", "p10", "p25", "p50", "p75", "p90", "max")


def score_quantiles(matches: DataFrame, approximate: bool = False) -> DataFrame:
    """A17. Exact by default: percentile keeps one count per distinct value and
    scores have 6 decimals, so its state is bounded by a million entries."""
    probs = F.array(*[F.lit(q) for q in QUANTILES])
    q = F.percentile_approx("score", probs, 100_000) if approximate else F.percentile("score", probs)
    return matches.agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select(
        "n", *[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILE_NAMES)]
    )


COMPONENTS = ("s_price", "s_area", "s_rooms", "s_baths", "s_operation")


def score_correlations(matches: DataFrame) -> DataFrame:
    """Pearson, NULL where a component does not vary."""
    def corr(c: str) -> Column:
        spread = F.stddev_pop(c)
        return F.covar_pop(c, "score") / F.nullif(F.when(spread > 1e-12, spread) * F.stddev_pop("score"), F.lit(0.0))

    return matches.agg(*[corr(c).alias(f"corr_{c[2:]}") for c in COMPONENTS])


def rank_audit(matches: DataFrame) -> DataFrame:
    """A19 + W6: clients with more than one match and how many break the order."""
    w = Window.partitionBy("client_id").orderBy("rank_client")
    prev_score, prev_price = F.lag("score").over(w), F.lag("s_price").over(w)
    rises = (F.col("score") > prev_score + 1e-12) | (
        (F.abs(F.col("score") - prev_score) <= 1e-12) & (F.col("s_price") > prev_price + 1e-12)
    )
    per_client = (
        matches.select("client_id", F.coalesce(rises, F.lit(False)).alias("bad"))
        .groupBy("client_id")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("bad").alias("bad"))
        .filter(F.col("n") > 1)
    )
    return per_client.agg(F.count(F.lit(1)).alias("groups"), F.count_if("bad").alias("violations"))


def score_extremes(matches: DataFrame, n: int = 3) -> DataFrame:
    """T4: the n best and n worst matches."""
    tie = ["client_id", "property_id"]
    top = matches.orderBy(F.desc("score"), *tie).limit(n).withColumn("extreme", F.lit("top"))
    bottom = matches.orderBy(F.asc("score"), *tie).limit(n).withColumn("extreme", F.lit("bottom"))
    return top.unionByName(bottom)


# ------------------------------------------------------------------ facets
def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; operations come in their fixed order."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    if column == "tipo_de_operacion":
        order = F.array(*[F.lit(o) for o in OPERATION_ORDER])
        place = F.array_position(order, F.col("value"))
        return values.filter(place > 0).orderBy(place)
    return values.orderBy("value")


def load_report(new: DataFrame, today: DataFrame) -> DataFrame:
    """Rows of both tables of one run."""
    return new.agg(F.count(F.lit(1)).alias("new_rows")).withColumn("today_rows", today.agg(F.count(F.lit(1))).scalar())
