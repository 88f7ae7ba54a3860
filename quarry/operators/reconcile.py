"""V1–V7: result comparison (the evaluation harness re-aimed as table
reconciliation).  Every check is a join or a column expression over whole
tables; nothing is compared on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances of the reference's comparisons.
EXACT_TOLERANCE = 1e-6
ABS_TOLERANCE = 0.05
REL_TOLERANCE = 0.001
NUMBER_PATTERN = r"(?i)-?\d+(?:,\d{3})*(?:\.\d+)?(?:e[+-]?\d+)?"


def _reconcile(expected: DataFrame, actual: DataFrame, key: list[str], value: str, within) -> DataFrame:
    e = expected.select(*key, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(*key, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    j = e.join(a, key, "full_outer")
    ed, ad = F.col("expected").try_cast("double"), F.col("actual").try_cast("double")
    numeric = ed.isNotNull() & ad.isNotNull()
    equal = F.when(numeric, within(ad, ed)).otherwise(F.col("expected").cast("string") == F.col("actual").cast("string"))
    status = (
        F.when(F.col("_a").isNull(), "missing_actual")
        .when(F.col("_e").isNull(), "unexpected")
        .when(F.col("expected").isNull() & F.col("actual").isNull(), "match")
        .when(equal, "match")
        .otherwise("mismatch")
    )
    return j.select(*key, "expected", "actual", status.alias("status"))


def reconcile_exact(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """V1: full outer join on the key; numbers equal within 1e-6."""
    return _reconcile(expected, actual, key, value, lambda a, e: F.abs(a - e) < EXACT_TOLERANCE)


def reconcile_tolerance(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """V2: |a − e| ≤ max(0.05, 0.1 % · |e|)."""
    return _reconcile(expected, actual, key, value, lambda a, e: F.abs(a - e) <= F.greatest(F.lit(ABS_TOLERANCE), F.abs(e) * REL_TOLERANCE))


def any_row_contains(results: DataFrame, row_id: str, expectations: DataFrame) -> DataFrame:
    """V3: for each expectation (exp_id, column, value) set, does any result row
    hold all its column=value pairs?  Results are unpivoted to (row, column,
    value) and equi-joined with the pairs, numbers by steps of the tolerance
    and their neighbours, other values as text; a row matches when it hits
    every pair of the expectation."""
    cols = [c for c in results.columns if c != row_id]
    longf = results.select(
        row_id, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_kv")
    ).select(row_id, "_kv.column", "_kv.value")
    need = expectations.groupBy("exp_id").agg(F.count(F.lit(1)).alias("_need"))
    number = F.col("value").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
    step = F.floor(number / EXACT_TOLERANCE)
    text = F.concat(F.lit("="), F.col("value"))
    left = longf.select(row_id, "column", F.when(finite, number).alias("_x"), F.when(finite, step.cast("string")).otherwise(text).alias("_k"))
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: (step + i).cast("string"))
    right = expectations.select(
        "exp_id", "column", "value", F.when(finite, number).alias("_y"), F.explode(F.when(finite, near).otherwise(F.array(text))).alias("_k")
    )
    same = F.col("_x").isNull() | (F.abs(F.col("_x") - F.col("_y")) < EXACT_TOLERANCE)
    pairs = right.join(left, ["column", "_k"]).where(same)
    hits = pairs.groupBy("exp_id", row_id).agg(F.count_distinct("column", "value").alias("_hit"))
    full = hits.join(need, "exp_id").where(F.col("_hit") == F.col("_need")).select("exp_id").distinct().withColumn("found", F.lit(True))
    return need.join(full, "exp_id", "left").select("exp_id", F.coalesce(F.col("found"), F.lit(False)).alias("found"))


def number_in_text(text: Column, expected: Column, tolerance: float | Column | None = None) -> Column:
    """V4: does the text mention a number (thousands commas and exponents
    allowed) within tolerance of ``expected``; default max(0.05, 0.1 %)."""
    if tolerance is None:
        tolerance = F.greatest(F.lit(ABS_TOLERANCE), F.abs(expected) * REL_TOLERANCE)
    nums = F.transform(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), 0), lambda s: F.replace(s, F.lit(",")).try_cast("double"))
    return F.coalesce(F.exists(nums, lambda x: F.abs(x - expected) <= tolerance), F.lit(False))


def keyword_coverage(text: Column, keywords: list[str]) -> Column:
    """V5: required keywords missing from the text (array, in given order)."""
    arr = F.array(*[F.lit(k) for k in keywords])
    return F.filter(arr, lambda k: ~F.coalesce(text.contains(k), F.lit(False)))


def completeness_check(expected: DataFrame, actual: DataFrame, parent: str) -> DataFrame:
    """V6: parents with fewer sub-results than sub-questions get a warning with
    both counts (count per parent on both sides, left join)."""
    e = expected.groupBy(parent).agg(F.count(F.lit(1)).alias("expected_count"))
    a = actual.groupBy(parent).agg(F.count(F.lit(1)).alias("actual_count"))
    j = e.join(a, parent, "left").withColumn("actual_count", F.coalesce(F.col("actual_count"), F.lit(0)))
    return j.where(F.col("actual_count") < F.col("expected_count")).withColumn("severity", F.lit("warning"))


def evidence_filter(findings: DataFrame, parent: str, evidence: str) -> tuple[DataFrame, DataFrame]:
    """V7: keep findings that carry evidence; warn for parents left with none.
    Returns (kept findings, per-parent counts with a warning flag)."""
    has = F.coalesce(F.length(F.col(evidence)) > 0, F.lit(False))
    kept = findings.where(has)
    per = findings.groupBy(parent).agg(F.count(F.lit(1)).alias("findings"), F.count_if(has).alias("kept"))
    return kept, per.withColumn("warning", F.col("kept") == 0)

