"""Predicates, time scopes and coercions.

Filters arrive as the reference's ``"col=value"`` strings or as keyword
arguments; both become Catalyst predicates, so equality filters reach the
Parquet scan as ``PushedFilters``.  Every "scalar" a scope needs (latest month,
median count) is a one-row DataFrame joined back with a broadcast, never a
collected value, so each operator stays one lazy plan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from quarry.functions.columns import latest_complete_period, month_label, month_of

# Control prefixes and the all-period label of the reference.
NOT_NULL = "__NOT_NULL__"
ALL_PERIODS_LABEL = "全期间"
PERIOD_PATTERN = r"(\d{4})[-/年\s]*(1[0-2]|0?[1-9])"


def parse_period(text: str) -> str | None:
    """``yyyy[-/年 ]m`` → ``yyyy-mm-01`` (argument parsing, driver side)."""
    m = re.search(PERIOD_PATTERN, text.strip())
    if not m:
        return None
    return f"{int(m.group(1)):04d}-{int(m.group(2)):02d}-01"


def filter_predicate(df: DataFrame, filters: list[str] | None) -> Column:
    """F1 + F2: AND of ``col=value`` / ``col=__NOT_NULL__``; items without ``=``
    and control keys (``__…``) are skipped; quotes are stripped; the literal is
    cast to the column type (a bad literal matches nothing)."""
    preds: list[Column] = []
    for item in filters or []:
        if "=" not in item:
            continue
        col, value = (s.strip() for s in item.split("=", 1))
        if not col or col.startswith("__"):
            continue
        if value == NOT_NULL:
            preds.append(F.col(col).isNotNull())
            continue
        value = value.strip("'\"")
        dtype = df.schema[col].dataType
        preds.append(F.col(col) == F.lit(value).try_cast(dtype))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def equality_filter(df: DataFrame, filters: list[str] | None) -> DataFrame:
    return df.where(filter_predicate(df, filters))


def not_null_filter(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def with_period(df: DataFrame, time_col: str | None, name: str = "_period") -> DataFrame:
    """Attach the F9 month bucket (null when there is no time column)."""
    if time_col and time_col in df.columns:
        return df.withColumn(name, month_of(df, time_col))
    return df.withColumn(name, F.lit(None).cast("date"))


def period_scope(df: DataFrame, time_col: str, period: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """rows of one month, or of an inclusive month range."""
    if period:
        p = parse_period(period)
        return df.where(in_months(df, time_col, p, p) if p else F.lit(False))
    return df.where(in_months(df, time_col, parse_period(start) if start else None, parse_period(end) if end else None))


def in_months(df: DataFrame, time_col: str, first: str | None, last: str | None) -> Column:
    """Rows of the months ``first`` to ``last``.  On date and timestamp columns
    a half-open range of the plain column, which the scan can prune by; text
    has to be parsed first."""
    kind = df.schema[time_col].dataType
    pred = F.lit(True)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        if first:
            pred = pred & (F.col(time_col) >= F.lit(first).cast("date").cast(kind))
        if last:
            year, month = int(last[:4]), int(last[5:7])
            after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
            pred = pred & (F.col(time_col) < F.lit(after).cast("date").cast(kind))
        return pred
    m = month_of(df, time_col)
    if first:
        pred = pred & (m >= F.lit(first).cast("date"))
    if last:
        pred = pred & (m <= F.lit(last).cast("date"))
    return pred


def month_of_year_scope(df: DataFrame, time_col: str, month: int) -> DataFrame:
    """month-of-year across all years."""
    return df.where(F.month(month_of(df, time_col)) == int(month))


def latest_period_table(df: DataFrame, time_col: str) -> DataFrame:
    """F5 as a one-row table with ``latest_period`` (DATE)."""
    return latest_complete_period(with_period(df, time_col), "_period")


def late_outlier_periods(df: DataFrame, time_col: str) -> DataFrame:
    """months after the latest complete month, with their row counts."""
    w = with_period(df, time_col)
    counts = w.where(F.col("_period").isNotNull()).groupBy("_period").agg(F.count(F.lit(1)).alias("row_count"))
    latest = latest_complete_period(w, "_period")
    return (
        counts.join(F.broadcast(latest), F.col("_period") > F.col("latest_period"))
        .select(month_label(F.col("_period")).alias("period"), "row_count")
    )


def last_period(period) -> str | None:
    """Several requested periods: templates use the last valid one."""
    if isinstance(period, (list, tuple)):
        valid = [x for x in period if x and parse_period(x)]
        return valid[-1] if valid else None
    return period


def start_end_periods(periods: list[str], start: str | None = None, end: str | None = None) -> tuple[str | None, str | None]:
    """Explicit start/end win; else the min (and, with two or more, the max)
    of the requested periods."""
    parsed = sorted(p for p in (parse_period(x) for x in periods or []) if p)
    s = parse_period(start) if start else (parsed[0] if parsed else None)
    e = parse_period(end) if end else (parsed[-1] if len(parsed) >= 2 else None)
    return s, e


def _explicit_scope(w: DataFrame, time_col: str | None, period, month: int | None) -> DataFrame | None:
    """Rows of the asked-for month with their label; every row (label 全期间)
    if the table has no valid month at all; None without a valid request.  The
    second branch is an empty relation, and not scanned, if there is a month."""
    period = last_period(period)
    p = parse_period(period) if period else None
    if not p and not (month and 1 <= int(month) <= 12):
        return None
    everything = w.withColumn("scope_label", F.lit(ALL_PERIODS_LABEL))
    if not time_col or time_col not in w.columns or w.schema["_period"].dataType != DateType():
        return everything
    if p:
        hit = w.where(in_months(w, time_col, p, p)).withColumn("scope_label", F.lit(p[:7]))
    else:
        hit = w.where(F.month("_period") == int(month)).withColumn("scope_label", F.lit(f"{int(month)} 月"))
    no_month = w.agg(F.max("_period").alias("_m")).where(F.col("_m").isNull()).select(F.lit(True).alias("_none"))  # one row or none
    return hit.unionByName(everything.crossJoin(F.broadcast(no_month)).drop("_none"))


def scope_month_or_latest(df: DataFrame, time_col: str | None, period: str | None = None, month: int | None = None) -> DataFrame:
    """with no usable month in the table, every row (label 全期间); else
    explicit period > month-of-year > latest complete month.  Adds ``_period`` and
    ``scope_label`` columns."""
    w = with_period(df, time_col)
    explicit = _explicit_scope(w, time_col, period, month)
    if explicit is not None:
        return explicit
    latest = latest_complete_period(w, "_period")
    joined = w.crossJoin(F.broadcast(latest))
    return joined.where(F.col("latest_period").isNull() | (F.col("_period") == F.col("latest_period"))).select(
        *w.columns, F.coalesce(month_label(F.col("latest_period")), F.lit(ALL_PERIODS_LABEL)).alias("scope_label")
    )


def scope_month_or_all(df: DataFrame, time_col: str | None, period: str | None = None, month: int | None = None) -> DataFrame:
    """F8: like F7, but the default is every row."""
    w = with_period(df, time_col)
    explicit = _explicit_scope(w, time_col, period, month)
    if explicit is not None:
        return explicit
    return w.withColumn("scope_label", F.lit(ALL_PERIODS_LABEL))


def empty_filter_report(df: DataFrame, filters: list[str], metrics: list[str], dimensions: list[str]) -> DataFrame:
    """one ``unanswerable`` row when the visible filters match no row,
    else one ``answerable`` row with the match count."""
    matched = equality_filter(df, filters).agg(F.count(F.lit(1)).alias("matched_rows"))
    visible = [f for f in filters if "=" in f and not f.split("=", 1)[0].strip().startswith("__")]
    return matched.select(
        F.when(F.col("matched_rows") == 0, "unanswerable").otherwise("answerable").alias("status"),
        "matched_rows",
        F.lit(",".join(metrics)).alias("requested_metrics"),
        F.lit(",".join(dimensions)).alias("requested_dimensions"),
        F.lit(";".join(visible)).alias("requested_filters"),
    )


def tenant_scope(df: DataFrame, tenant_col: str, user_col: str, tenant: str, user: str, include_shared: bool = True) -> DataFrame:
    """rows of (tenant, user), optionally plus shared (system, system)."""
    pred = (F.col(tenant_col) == tenant) & (F.col(user_col) == user)
    if include_shared:
        pred = pred | ((F.col(tenant_col) == "system") & (F.col(user_col) == "system"))
    return df.where(pred)
