"""Scans and sinks."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.numeric import clean


def read_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, properties: dict | None = None) -> DataFrame:
    """A relational table, one task per predicate. Failed tasks are retried by Spark."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def load_variables(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """One Parquet source per variable, stacked as ``(date, code, value, variable)``."""
    if not names:
        raise ValueError("no variables named")
    out = None
    for n in names:
        one = spark.read.parquet(f"{folder}/{n}.parquet").select(
            F.col("date").cast("date").alias("date"), "code", clean(F.col("value").cast("double")).alias("value"), F.lit(n).alias("variable")
        )
        out = one if out is None else out.unionByName(one)
    return out


def variables_to_columns(stacked: DataFrame, names: list[str]) -> DataFrame:
    """One column per named variable: a grouping per cell instead of a chain of joins."""
    return stacked.groupBy("date", "code").agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])


def write_factor(df: DataFrame, path: str, mode: str = "errorifexists", files_per_month: int = 16) -> None:
    """Factor result by month of date, in a few files per month.

    Rows are hashed by month and a code hash, so a month with very many rows is written by
    several tasks and a task does not open a file for every month.
    """
    slot = F.pmod(F.xxhash64("code"), F.lit(files_per_month))
    by_month = df.withColumn("month", F.trunc("date", "month")).repartition("month", slot)
    by_month.write.mode(mode).partitionBy("month").parquet(path)


def write_audit(path: str, raw: DataFrame, aligned: DataFrame, universe: DataFrame, excluded: DataFrame) -> None:
    """The four audit tables of a run; aligned rows are split by variable."""
    raw.write.mode("errorifexists").parquet(f"{path}/raw")
    aligned.write.mode("errorifexists").partitionBy("variable").parquet(f"{path}/aligned")
    universe.write.mode("errorifexists").parquet(f"{path}/universe")
    excluded.write.mode("errorifexists").parquet(f"{path}/excluded")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file where none is, in one step; False if there is one. Of several writers exactly one makes it.

    A plain or ``file:`` path is a linked file, which is whole when it appears. Elsewhere it is the file system's own
    create without overwrite: HDFS lets one writer through; an object store must offer conditional puts.
    """
    where = urlparse(path)
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if where.scheme == "file" or not where.scheme and default.startswith("file:"):
        target = unquote(where.path) if where.scheme else path
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
        with open(draft, "x") as f:
            f.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    return hadoop_create_once(spark, path, text)


def hadoop_create_once(spark: SparkSession, path: str, text: str) -> bool:
    """``create_once`` through Hadoop's file system of the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(target, False)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def export_weights(df: DataFrame, path: str) -> None:
    df.select("date", "code", "weight").write.mode("errorifexists").csv(path, header=True)


CATALOG_SCHEMA = (
    "table string, field string, name string, description string, data_type string, fill_rate double, asset_type string,"
    " frequency string, market string, unit string, metadata_source string"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines field catalog; table and field names in lowercase."""
    df = spark.read.schema(CATALOG_SCHEMA).json(path)
    return df.withColumns({"table": F.lower("table"), "field": F.lower("field")})


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_events(events: DataFrame, after: int, session: str | None = None) -> DataFrame:
    """Events after a cursor; both filters reach the scan."""
    out = events.filter(F.col("sequence") > after)
    return out if session is None else out.filter(F.col("session_id") == session)


def merge_catalogs(index: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Field index and dictionary by (table, field): the dictionary wins, index-only rows keep a NULL source."""
    rest = [c for c in dictionary.columns if c not in ("table", "field", "metadata_source")]
    keys = index.select("table", "field").distinct()
    return keys.join(dictionary, ["table", "field"], "full_outer").select("table", "field", *rest, "metadata_source")


def catalog_coverage(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count(F.lit(1)).alias("fields"), F.count("metadata_source").alias("described"),
        F.coalesce(F.avg(F.col("metadata_source").isNotNull().cast("double")), F.lit(0.0)).alias("coverage"),
    )
