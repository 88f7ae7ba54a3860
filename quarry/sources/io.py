"""Scans, sinks, catalog and the guarded SELECT surface."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DecimalType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType

# Default caps of the reference (rows, columns, result rows).
MAX_ROWS = 250_000
MAX_COLUMNS = 200


# ---------------------------------------------------------------- S1/S2 ----
def read_csv_dataset(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV; explicit schema when given (no inference pass), else
    inferred.  A UTF-8 BOM on the first header is removed by S2."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return normalise_headers(reader.csv(path))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip names (and a leading BOM); reject empty names and names that
    collide case-insensitively (Spark resolves names case-insensitively)."""
    names = [c.replace("﻿", "").strip() for c in df.columns]
    if any(not n for n in names):
        raise ValueError("empty column name")
    lowered = [n.lower() for n in names]
    if len(set(lowered)) != len(lowered):
        raise ValueError(f"duplicate column names: {names}")
    return df.toDF(*names)


# ---------------------------------------------------------------- S3/S4/S7 -
def dataset_admission(df: DataFrame, name: str, max_rows: int | None = None, max_cols: int | None = None) -> DataFrame:
    """S3: one row per rule (row cap, column cap) with the observed value and
    whether it passes.  Caps are off (None) by default.  The row count is a
    plain distributed count (partial counts per task; Parquet answers it from
    footers) — an unordered ``limit`` would funnel rows into one task."""
    rows = df.agg(F.count(F.lit(1)).alias("observed"))
    row_rule = rows.select(
        F.lit(name).alias("dataset"), F.lit("max_rows").alias("rule"), F.lit(max_rows).cast("bigint").alias("limit"), "observed",
        (F.lit(max_rows).isNull() | (F.col("observed") <= F.lit(max_rows))).alias("passed"),
    )
    ncols = len(df.columns)
    col_rule = rows.select(
        F.lit(name).alias("dataset"), F.lit("max_columns").alias("rule"), F.lit(max_cols).cast("bigint").alias("limit"), F.lit(ncols).cast("bigint").alias("observed"),
        F.lit(max_cols is None or ncols <= max_cols).alias("passed"),
    )
    return row_rule.unionByName(col_rule)


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First n rows by a key, 1 at least."""
    return df.orderBy(*order_by).limit(max(1, int(n)))


def result_cap(df: DataFrame, order_by: list, n: int | None = None) -> DataFrame:
    """The rows in a deterministic order, all of them or the first n."""
    ordered = df.orderBy(*order_by)
    return ordered if n is None else ordered.limit(max(1, int(n)))


# ---------------------------------------------------------------- S5/S6 ----
def _normalise(col, dt):
    if isinstance(dt, (DoubleType, FloatType)):
        x = col.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if isinstance(dt, DecimalType):
        return col.cast("double")
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(dt, DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dt, ArrayType):
        return F.transform(col, lambda e: _normalise(e, dt.elementType))
    if isinstance(dt, StructType):
        return F.struct(*[_normalise(col[f.name], f.dataType).alias(f.name) for f in dt.fields])
    if isinstance(dt, MapType):
        return F.transform_values(col, lambda k, v: _normalise(v, dt.valueType))
    return col


def to_records(df: DataFrame) -> DataFrame:
    """Per value NaN/±Inf → null, Decimal → double, date/time → ISO
    text, nested values handled recursively (all column expressions)."""
    return df.select(*[_normalise(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def json_sink(df: DataFrame, path: str) -> DataFrame:
    """Write normalised records as JSON lines (overwrite) and read them
    back with the normalised schema."""
    rec = to_records(df)
    rec.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(rec.schema).json(path)


# ---------------------------------------------------------------- S8-S10 ---
def dataset_catalog(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: row and column counts and the column list."""
    parts = [
        f.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("dataset"), "row_count", F.lit(len(f.columns)).alias("column_count"), F.lit(",".join(f.columns)).alias("columns")
        )
        for name, f in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def catalog_listing(catalog: DataFrame, created_at: str, key: str, tenant_col: str | None = None, tenant: str | None = None,
                    user_col: str | None = None, user: str | None = None, n: int | None = None) -> DataFrame:
    """Optional tenant/user equality, newest first (ties by key)."""
    pred = F.lit(True)
    if tenant_col and tenant is not None:
        pred = pred & (F.col(tenant_col) == tenant)
    if user_col and user is not None:
        pred = pred & (F.col(user_col) == user)
    out = catalog.where(pred).orderBy(F.col(created_at).desc(), F.col(key))
    return out.limit(n) if n else out


def dataset_retention(catalog: DataFrame, created_at: str, cutoff: str, days: int) -> DataFrame:
    """Rows created before ``cutoff − days`` are expired; days ≤ 0
    disables expiry.  The cutoff is an argument, never ``now()``."""
    if days <= 0:
        return catalog.withColumn("expired", F.lit(False))
    limit = F.lit(cutoff).cast("timestamp") - F.make_interval(days=F.lit(days))
    return catalog.withColumn("expired", F.col(created_at).cast("timestamp") < limit)


# ---------------------------------------------------------------- S11 ------
# Leaves that the analysed plan of a user SELECT may have where the
# relation dataset is one row without a table, and nodes that it may not have.
ALLOWED_LEAVES = ["OneRowRelation", "CTERelationRef", "UnionLoopRef"]
REFUSED_NODES = ["ScriptTransformation", "CallMethodViaReflection", "TryReflect", "StaticInvoke", "PythonUDF"]


def _check_plan(found: DataFrame) -> None:
    """ValueError unless the analysed plan of ``found``, subqueries included,
    reads nothing and calls no outside code."""
    plan = found._jdf.queryExecution().analyzed()
    below = plan.subqueriesAll()
    for p in [plan, *[below.apply(i) for i in range(below.size())]]:
        leaves = p.collectLeaves()
        kinds = {leaves.apply(i).getClass().getSimpleName().rstrip("$") for i in range(leaves.size())}
        if kinds - set(ALLOWED_LEAVES):
            raise ValueError(f"only dataset may be read, not {', '.join(sorted(kinds - set(ALLOWED_LEAVES)))}")
        # names of classes stand in quotes of their own, which a literal's text cannot hold
        used = {name.rsplit(".", 1)[-1] for name in re.findall(r'(?<!\\)"class":"([\w.$]+)"', p.toJSON())}
        if used & set(REFUSED_NODES):
            raise ValueError(f"not allowed in a SELECT: {', '.join(sorted(used & set(REFUSED_NODES)))}")


def guarded_select(df: DataFrame, sql: str, limit: int | None = None) -> DataFrame:
    """A user's SELECT over the relation ``dataset`` and nothing else.

    Spark analyses the text as a subquery, so it can only be one query, in a
    session of its own that reads no files by path.  There ``dataset`` is first
    an empty stand-in: whatever the plan then reads beside it is refused (other
    tables, views, files, table functions).  The same text is then bound to the
    frame.  The caller's session gets no view and no setting.  All rows come
    back unless a ``limit`` is given."""
    spark = df.sparkSession
    text = f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)"
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    stand_in = own.sql("SELECT 1").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    stand_in.createOrReplaceTempView("dataset")
    try:
        _check_plan(own.sql(text))
    except PySparkException as e:
        raise ValueError(f"only a SELECT over dataset may run: {e}") from e
    name = f"dataset_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        own.table(f"global_temp.{name}").createOrReplaceTempView("dataset")
        found = own.sql(text)
    finally:
        spark.catalog.dropGlobalTempView(name)
    return found if limit is None else found.limit(max(1, int(limit)))
