"""Score diagnostics of a match table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from listing_engine.operators import aggregates as A


def match_diagnostics(matches: DataFrame) -> dict[str, DataFrame]:
    """Distribution, correlations, order audit and extremes."""
    return {
        "quantiles": A.score_quantiles(matches),
        "correlations": A.score_correlations(matches),
        "rank_audit": A.rank_audit(matches),
        "extremes": A.score_extremes(matches),
    }
