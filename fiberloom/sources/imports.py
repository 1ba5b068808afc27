"""Documents from elsewhere as tables: findings and calibration targets in JSON, changes from version control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "array<struct<path: string, line: long, symbol: string>>"
FINDINGS = f"detector string, subject string, n long, evidence {EVIDENCE}"
TARGETS = (
    "name string, path string, expected_detectors array<struct<detector_id: string, min_count: long, max_count: long>>, forbidden_detectors array<string>,"
    " max_production_findings long, max_test_only_findings long, max_scan_seconds double"
)
CHANGES = "added string, deleted string, path string"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of another checker, one JSON object a line; a line of other types is an error."""
    return spark.read.schema(FINDINGS).option("mode", "FAILFAST").json(path)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(target, detector, low, high) of a calibration manifest ``{"targets": [...]}``; forbidden detectors have high = 0."""
    whole = spark.read.schema(f"targets array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in spark.createDataFrame([], TARGETS).schema)}>>").option("mode", "FAILFAST").option("multiLine", True).json(path)
    t = whole.select(F.explode("targets").alias("t")).select("t.*")
    wanted = t.select(F.col("name").alias("target"), F.explode("expected_detectors").alias("e")).select("target", F.col("e.detector_id").alias("detector"), F.coalesce("e.min_count", F.lit(1)).cast("long").alias("low"), F.col("e.max_count").alias("high"))
    barred = t.select(F.col("name").alias("target"), F.explode("forbidden_detectors").alias("detector"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    return wanted.unionByName(barred)


def gate(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """(target, detector, n, reason) of targets against findings (detector, ...): ok, too few, too many or forbidden."""
    counts = findings.groupBy("detector").agg(F.count("*").alias("n"))
    met = targets.join(counts, "detector", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("n") < F.col("low"), "too few").when((F.col("high") == 0) & (F.col("n") > 0), "forbidden").when(F.col("n") > F.col("high"), "too many").otherwise("ok")
    return met.select("target", "detector", "n", reason.alias("reason"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """(path, added, deleted) of saved ``git diff --numstat`` output; rows of binary files, whose numbers are ``-``, are left out."""
    rows = spark.read.schema(CHANGES).option("sep", "\t").csv(path).where("added <> '-' and deleted <> '-'")
    return rows.select("path", F.col("added").cast("long").alias("added"), F.col("deleted").cast("long").alias("deleted"))
