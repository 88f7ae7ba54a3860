"""128-bit row fingerprints: whole rows are compared, and shuffled, only where
their fingerprints are equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRINT = ["_fp_hi", "_fp_lo"]


def fingerprint(cols: list[str]) -> list[Column]:
    """Two 64-bit hashes of the columns.  Which of them are null is hashed as
    well, since Spark's hashes skip nulls."""
    nulls = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(F.lit(salt), nulls, *[F.col(c) for c in cols]).alias(name) for salt, name in enumerate(PRINT)]


def same_row(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> Column:
    """Fingerprints equal, and then the columns compared one by one (as a
    condition beside the join's keys, so only fingerprints are shuffled on)."""
    equal = reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in zip(left, right, strict=True)])
    keys = reduce(lambda x, y: x & y, [a[p] == b[f"{p}_b"] for p in PRINT])
    return keys & F.when(equal, True).otherwise(False)


def repeated_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per combination of ``cols`` that occurs more than once: its
    fingerprint, the columns, and ``_n``, how often it occurs.  Fingerprints are
    counted first; rows whose fingerprint is alone are not shuffled."""
    cols = cols or df.columns
    marked = df.select(*fingerprint(cols), *cols)
    again = marked.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*PRINT)
    return marked.join(again, PRINT, "left_semi").groupBy(*PRINT, *cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
