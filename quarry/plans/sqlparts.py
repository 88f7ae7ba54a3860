"""Small SQL text helpers for the DuckDB oracles (test side only)."""

from __future__ import annotations

from quarry.functions.columns import MASK_PATTERNS


def mask(col: str, kind: str) -> str:
    """F10 in DuckDB: case-insensitive regex on the text form, null → false."""
    return f"coalesce(regexp_matches(CAST({col} AS VARCHAR), '{MASK_PATTERNS[kind]}', 'i'), false)"


def latest(source: str, period: str = "month", where: str = "TRUE") -> str:
    """F5 as a scalar subquery over ``source``."""
    return (
        "(SELECT coalesce(max(CASE WHEN n >= greatest(1.0, m * 0.5) THEN p END), max(p)) FROM "
        f"(SELECT p, n, median(n) OVER () AS m FROM (SELECT {period} AS p, count(*) AS n FROM {source} "
        f"WHERE {period} IS NOT NULL AND ({where}) GROUP BY 1)))"
    )


def guarded_corr(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (
        f"(covar_samp(CASE WHEN {both} THEN {a} END, CASE WHEN {both} THEN {b} END) / "
        f"nullif(stddev_samp(CASE WHEN {both} THEN {a} END) * stddev_samp(CASE WHEN {both} THEN {b} END), 0))"
    )


def margin(p: str, s: str) -> str:
    return f"round(coalesce({p} / nullif({s}, 0), 0), 4)"
