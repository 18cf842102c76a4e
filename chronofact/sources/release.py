"""Frozen releases: freeze certificate and read-only verification.

Files are hashed by a distributed scan and compared by a full outer join. Only
the small JSON documents of a release (manifest, certificate, comparison) and
the verdict pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import inventory
from . import files

MANIFEST = "private/eval/manifest.json"
VALIDATION = "private/eval/validation.json"

_MANIFEST_SCHEMA = ("state string, dataset_version string, logical_inventory_digest string, "
                    "validation_sha256 string, file_inventory map<string,string>")
_CERTIFICATE_SCHEMA = ("dataset_version string, state string, manifest_sha256 string, "
                       "comparison_report_sha256 string, logical_inventory_digest string, "
                       "dfg map<string,struct<status:string>>")
_COMPARISON_SCHEMA = "status string, mismatches array<map<string,string>>, inventory_digest string"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document with the hash of its exact bytes."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.sha2("content", 256).alias("sha256"),
                      F.from_json(F.decode("content", "UTF-8"), schema).alias("d")).select("sha256", "d.*")


def declared_inventory(spark: SparkSession, release: str) -> DataFrame:
    manifest = _document(spark, f"{release}/{MANIFEST}", _MANIFEST_SCHEMA)
    return manifest.select(F.explode("file_inventory").alias("path", "sha256"))


def compare_releases(spark: SparkSession, a: str, b: str) -> DataFrame:
    """File by file difference of two candidates."""
    return inventory.diff(files.inventory(spark, a), files.inventory(spark, b))


def file_findings(spark: SparkSession, release: str) -> DataFrame:
    """Every file of a release that differs from its manifest."""
    actual = files.inventory(spark, release).where(F.col("path") != MANIFEST)
    return inventory.diff(declared_inventory(spark, release), actual)


def document_errors(spark: SparkSession, release: str, certificate: str, comparison: str) -> DataFrame:
    """Contradictions between manifest, certificate and comparison report."""
    m = _document(spark, f"{release}/{MANIFEST}", _MANIFEST_SCHEMA).select(F.struct("*").alias("m"))
    # a release without the report has no row here, which is a difference, too
    report = spark.read.format("binaryFile").option("pathGlobFilter", VALIDATION.rsplit("/", 1)[1]).load(f"{release}/{VALIDATION.rsplit('/', 1)[0]}")
    v = report.select(F.sha2("content", 256).alias("v")).agg(F.max("v"))
    c = _document(spark, certificate, _CERTIFICATE_SCHEMA).select(F.struct("*").alias("c"))
    p = _document(spark, comparison, _COMPARISON_SCHEMA).select(F.struct("*").alias("p"))
    # Three one-row documents side by side.
    one = m.withColumn("c", c.scalar()).withColumn("p", p.scalar()).withColumn("v", v.scalar())
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    failed = F.filter(F.map_entries("c.dfg"), lambda e: ~e["value"]["status"].eqNullSafe(F.lit("pass")))
    fixed = F.filter(F.array(
        F.when(~F.col("m.state").eqNullSafe(F.lit("FROZEN")), "release state is not FROZEN"),
        F.when(~F.col("c.state").eqNullSafe(F.lit("FROZEN")), "certificate state is not FROZEN"),
        F.when(differs("m.dataset_version", "c.dataset_version"), "dataset version mismatch"),
        F.when(differs("m.sha256", "c.manifest_sha256"), "manifest SHA-256 mismatch"),
        F.when(differs("p.sha256", "c.comparison_report_sha256"), "comparison report SHA-256 mismatch"),
        F.when(differs("m.validation_sha256", "v"), "validation report SHA-256 mismatch"),
        F.when(differs("m.logical_inventory_digest", "c.logical_inventory_digest")
               | differs("p.inventory_digest", "c.logical_inventory_digest"), "logical inventory digest mismatch"),
        F.when(~F.col("p.status").eqNullSafe(F.lit("pass")) | (F.size("p.mismatches") > 0),
               "comparison report does not record a clean pass"),
    ), lambda e: e.isNotNull())
    gates = F.transform(failed, lambda e: F.concat(e["key"], F.lit(" is not pass")))
    return one.select(F.explode(F.concat(fixed, gates)).alias("error"))


def verify_frozen(spark: SparkSession, release: str, certificate: str, comparison: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one-row report, file findings, document errors); nothing is written."""
    found = file_findings(spark, release)
    errors = document_errors(spark, release, certificate, comparison)
    count = errors.agg(F.count("*").alias("n"))
    report = inventory.summary(found).withColumn("errors", count.scalar()).withColumn(
        "status", F.when((F.col("status") == "pass") & (F.col("errors") == 0), "pass").otherwise("fail"))
    return report, found.where("state <> 'match'"), errors
