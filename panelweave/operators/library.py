"""Published factors: versions, content fingerprints, provenance and differences."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.files import create_once

VERSIONS = (
    "factor_spec_version", "execution_plan_version", "preprocessing_version", "time_convention_version",
    "field_metadata_version", "metric_definition_version", "adapter_version", "code_commit", "runtime_version",
)
ENTRY = "factor_id string, version long, row_count long, content_hash string, metric_keys array<string>, review_status string, review_note string"
INFER_KEY = "spark.sql.sources.partitionColumnTypeInference.enabled"


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash: two sums of the rows' 64-bit hashes, each with a seed of its own.

    Sums commute, so partitioning and row order do not change it, and equal rows count each time. Each
    column is hashed with whether it is NULL, since a NULL alone leaves a hash as it was.
    """
    cells = [x for c in sorted(df.columns) for x in (F.col(c).isNull(), F.col(c))]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")).cast("string"), F.lit("0")) for seed in (0, 1)]
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws(":", *sums).alias("content_hash"))


def verify_content(df: DataFrame, recorded: DataFrame) -> DataFrame:
    """Whether stored content still has its recorded fingerprint. Both sides are one row."""
    r = recorded.select(F.col("row_count").alias("_n"), F.col("content_hash").alias("_h"), F.lit(0).alias("_k"))
    return fingerprint(df).withColumn("_k", F.lit(0)).join(r, "_k").select(
        "row_count", "content_hash", ((F.col("row_count") == F.col("_n")) & (F.col("content_hash") == F.col("_h"))).alias("unchanged")
    )


def publish(df: DataFrame, root: str, factor_id: str, metric_keys: list[str], registry: DataFrame) -> int:
    """Write the next version of a factor and return its number.

    A number is claimed by a file that is made only where none is, so whoever comes second to it takes the next
    one. The rows then land in the version's folder, and the version comes to be in one step, when its entry appears:
    readers go by entries, so a write that is under way or has died is never listed or read, and the
    number of one that died stays unused. Nothing is ever replaced. The entry keeps the fingerprint of the stored
    rows for ``verify_version``.

    Disputed or unregistered metrics are refused before anything is written, and unreviewed ones are labelled.
    """
    from panelweave.operators.composite import review_gate

    if not factor_id:
        raise ValueError("a published factor needs a name")
    spark = df.sparkSession
    label = review_gate(metric_keys, registry).first()
    name = hashlib.sha256(factor_id.encode()).hexdigest()
    last = read_entries(spark, root).filter(F.col("factor_id") == factor_id).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    while not create_once(spark, f"{root}/_claims/{name}.{version}", ""):
        version += 1
    folder = _folder(root, factor_id, version)
    df.withColumns({"review_status": F.lit(label.review_status), "review_note": F.lit(label.review_note)}).write.mode("errorifexists").parquet(folder)
    kept = fingerprint(spark.read.parquet(folder)).first()
    entry = {
        "factor_id": factor_id, "version": version, "row_count": kept.row_count, "content_hash": kept.content_hash, "metric_keys": metric_keys,
        "review_status": label.review_status, "review_note": label.review_note,
    }
    if not create_once(spark, f"{root}/_entries/{name}.{version}.json", json.dumps(entry)):
        raise FileExistsError(f"{factor_id} has a version {version} already")
    return version


def _folder(root: str, factor_id: str, version: int) -> str:
    return f"{root}/factor_id={quote(factor_id, safe='')}/version={version}"


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """A row per published version; none before the first one. A file that is not whole is no entry."""
    try:
        found = spark.read.schema(ENTRY).json(f"{root}/_entries")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)
    return found.filter("factor_id is not null and version is not null and content_hash is not null")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """All folders of versions, published or not. Names stay text, so that 007 is not 7."""
    before = spark.conf.get(INFER_KEY)
    spark.conf.set(INFER_KEY, "false")
    try:
        found = spark.read.option("basePath", root).parquet(root)
    finally:
        spark.conf.set(INFER_KEY, before)
    return found.withColumn("version", F.col("version").cast("long"))


def read_library(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all published versions; filters on factor and version prune folders."""
    return _stored(spark, root).join(read_entries(spark, root), ["factor_id", "version"], "left_semi")


def verify_version(spark: SparkSession, root: str, factor_id: str, version: int) -> DataFrame:
    """``verify_content`` of one published version; no row where there is no such version."""
    entry = read_entries(spark, root).filter((F.col("factor_id") == factor_id) & (F.col("version") == version))
    if entry.isEmpty():
        return verify_content(entry, entry).limit(0)
    return verify_content(spark.read.parquet(_folder(root, factor_id, version)), entry)


def unpublished(spark: SparkSession, root: str) -> DataFrame:
    """Versions with rows but no entry: writes under way, or left by a publisher that died."""
    return _stored(spark, root).select("factor_id", "version").distinct().join(read_entries(spark, root), ["factor_id", "version"], "left_anti")


def get_version(library: DataFrame, factor_id: str, version: int) -> DataFrame:
    """One version; both filters prune folders."""
    return library.filter((F.col("factor_id") == factor_id) & (F.col("version") == version))


def versions(entries: DataFrame) -> DataFrame:
    return entries.groupBy("factor_id", "version").agg(F.count(F.lit(1)).alias("rows"))


def latest_versions(entries: DataFrame) -> DataFrame:
    """Newest version per factor with its entry's columns."""
    rest = [c for c in entries.columns if c not in ("factor_id", "version")]
    best = entries.groupBy("factor_id").agg(F.max_by(F.struct("version", *rest), F.struct("version", *rest)).alias("_b"))
    return best.select("factor_id", "_b.*")


def explain_difference(a: DataFrame, b: DataFrame, versions: tuple = VERSIONS) -> DataFrame:
    """Recorded reasons why two provenance records of a factor differ.

    Records have (factor_id, manifest, result, input_hashes ARRAY, and the version columns).
    """
    have = [v for v in versions if v in a.columns and v in b.columns]
    r = b.select("factor_id", *[F.col(c).alias(f"_b_{c}") for c in ["manifest", "result", "input_hashes", *have]])
    both = a.join(r, "factor_id")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    other_inputs = (F.size(F.array_except("input_hashes", "_b_input_hashes")) > 0) | (F.size(F.array_except("_b_input_hashes", "input_hashes")) > 0)
    changed = F.array_sort(F.array_compact(F.array(*[F.when(differs(v), v) for v in have]))) if have else F.array().cast("array<string>")
    recorded = F.array_compact(F.array(
        F.when(differs("manifest"), "manifest"), F.when(other_inputs, "inputs"),
        F.when(F.size(changed) > 0, F.concat(F.lit("versions:"), F.array_join(changed, ","))),
    ))
    reasons = F.when((F.size(recorded) == 0) & differs("result"), F.array(F.lit("unexplained"))).otherwise(recorded)
    return both.select("factor_id", reasons.alias("reasons"))


def input_stats(df: DataFrame, date_col: str) -> DataFrame:
    """Date range, row count, schema and non-missing share of one input, in one aggregation."""
    filled = sum((F.count(c) for c in df.columns[1:]), F.count(df.columns[0]))
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(
        F.min(date_col).cast("date").alias("first_date"), F.max(date_col).cast("date").alias("last_date"), F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.try_divide(filled, F.count(F.lit(1)) * len(df.columns)), F.lit(0.0)).alias("non_null_ratio"),
    ).withColumn("input_schema", F.lit(schema))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Status per key that is not equal on both sides: added, removed or changed.

    Both sides are stacked and grouped by key, which pre-reduces each side before the shuffle.
    """
    rest = [c for c in a.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("_side"), F.struct(*rest).alias("_row"))

    met = side(a, "a").unionByName(side(b, "b")).groupBy(*keys).agg(
        F.count_if(F.col("_side") == "a").alias("_na"), F.count_if(F.col("_side") == "b").alias("_nb"),
        F.max(F.when(F.col("_side") == "a", F.col("_row"))).alias("_a"), F.max(F.when(F.col("_side") == "b", F.col("_row"))).alias("_b"),
    )
    status = F.when(F.col("_na") == 0, "added").when(F.col("_nb") == 0, "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return met.withColumn("status", status).filter("status is not null").select(*keys, "status")
