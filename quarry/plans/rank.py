"""Global rank numbers without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` plans a ``SinglePartition``
exchange: every row goes through one task.  :func:`global_row_number` instead
numbers rows with :func:`quarry.functions.quantiles.global_rank`: rows are
range-partitioned on the order keys, numbered inside each sorted range, and
offset by the row count of all earlier ranges (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.quantiles import global_rank


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (which should end in a unique
    key so the numbering is deterministic)."""
    return global_rank(df, order, name, partitions).withColumn(name, F.col(name).cast("int"))
