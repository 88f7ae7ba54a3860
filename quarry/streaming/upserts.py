"""A keyed table kept as a merged base and the change batches after it.

Layout under ``path``::

    changes/<batch>   the rows a batch inserted or replaced
    base/<batch>      one row a key: everything up to that batch
    state/<batch>     one row: which base and which changes make up the table

A batch is visible once its state row is written, which is the last step, so a
reader sees the table before or after a batch and never a part of one.  A batch
replayed after a failure finds its state row and changes nothing; without one,
it overwrites what its first try left.

The changes are merged into a new base when they hold more than ``merge_share``
of the base's rows.  A read therefore costs at most ``1 + merge_share`` times
the table (and one state row a batch), whatever its history, and a merge's cost
is spread over changes in proportion to it.  Merged files stay on disk, for
readers that still use them.

A key twice in one batch: the greatest row wins, so a replay gives the same
table.  Null keys are one key.  Values need an order (no maps).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MERGE_SHARE = 0.5
_STATE = "base long, base_rows long, changes array<struct<batch:long,rows:long>>, columns string"


class UpsertTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge_share: float = MERGE_SHARE):
        self.spark, self.path, self.keys, self.merge_share = spark, path.rstrip("/"), keys, merge_share

    def _states(self, batch: int | str) -> Row | None:
        try:
            found = self.spark.read.schema(_STATE).parquet(f"{self.path}/state/{batch}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        newest = F.max_by(F.struct("*"), F.greatest(F.col("base"), F.coalesce(F.array_max("changes.batch"), F.lit(-1))))
        row = found.agg(newest.alias("s")).first()["s"]  # one row
        return row

    def state(self) -> Row | None:
        """The newest state: base (-1: none), its rows, the changes after it."""
        return self._states("*")

    def _read(self, state: Row) -> DataFrame | None:
        places = [("base", state["base"])] if state["base"] >= 0 else []
        places += [("changes", c["batch"]) for c in state["changes"]]
        parts = [
            self.spark.read.schema(state["columns"]).parquet(f"{self.path}/{kind}/{batch}").withColumn("_batch", F.lit(batch).cast("long"))
            for kind, batch in places
        ]
        if len(parts) == 1 and places[0][0] == "base":
            return parts[0].drop("_batch")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        values = [c for c in every.columns if c not in (*self.keys, "_batch")]
        newest = every.groupBy(*self.keys).agg(F.max(F.struct("_batch", *values)).alias("_v"))
        return newest.select(*[F.col(c) if c in self.keys else F.col("_v")[c].alias(c) for c in every.columns if c != "_batch"])

    def rows(self) -> DataFrame:
        """The table: the newest row of every key."""
        state = self.state()
        if state is None:
            raise ValueError(f"no batch has been applied to {self.path}")
        return self._read(state)

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Inserts or replaces the rows of ``changes`` as batch number ``batch``
        (numbers ascend).  False if the batch had been applied before."""
        if self._states(batch) is not None:
            return False
        before = self.state()
        place = f"{self.path}/changes/{batch}"
        changes.write.mode("overwrite").parquet(place)
        written = self.spark.read.schema(changes.schema).parquet(place)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema.fields)
        base, base_rows, after = (before["base"], before["base_rows"], list(before["changes"])) if before else (-1, 0, [])
        after.append(Row(batch=batch, rows=written.count()))  # counted from the files' footers
        if sum(c["rows"] for c in after) > self.merge_share * base_rows:
            merged = f"{self.path}/base/{batch}"
            self._read(Row(base=base, base_rows=base_rows, changes=after, columns=columns)).write.mode("overwrite").parquet(merged)
            base, after = batch, []
            base_rows = self.spark.read.schema(changes.schema).parquet(merged).count()
        one = self.spark.createDataFrame([(base, base_rows, [tuple(c) for c in after], columns)], _STATE)
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{batch}")
        return True
