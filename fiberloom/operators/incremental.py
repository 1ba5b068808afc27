"""Recomputing only what changed: digests of rows and of whole inputs, partial results, predictions of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame) -> DataFrame:
    """``df`` with ``_hash`` of all its columns in order of name; nulls count as values."""
    return df.withColumn("_hash", F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})))


def input_digest(df: DataFrame) -> str:
    """One digest of a bag of rows, whatever their order: their number and sums of two halves of their hashes."""
    h = row_hash(df).select(F.conv(F.substring("_hash", 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring("_hash", 16, 15), 16, 10).cast("decimal(38,0)").alias("b"))
    row = h.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return "-".join(str(int(x)) for x in row)


def to_recompute(modules: DataFrame, manifest: DataFrame) -> DataFrame:
    """Modules whose (path, source_hash) the manifest does not have."""
    return modules.join(manifest.select("path", "source_hash"), ["path", "source_hash"], "left_anti")


def local_result(old: DataFrame, rerun: DataFrame, changed: DataFrame) -> DataFrame:
    """Old findings with no evidence in a changed path, and those of a rerun that have some; ``complete`` says that other
    findings were not looked for again."""
    touched = old.select("finding_id", F.explode("evidence").alias("e")).select("finding_id", F.col("e.path").alias("path")).join(changed.select("path"), "path", "left_semi").select("finding_id").distinct()
    kept = old.join(touched, "finding_id", "left_anti")
    near = rerun.select("finding_id", F.explode("evidence").alias("e")).select("finding_id", F.col("e.path").alias("path")).join(changed.select("path"), "path", "left_semi").select("finding_id").distinct()
    return kept.unionByName(rerun.join(near, "finding_id", "left_semi")).withColumn("complete", F.lit(False))


def predicted_seconds(last: DataFrame, modules_now: int) -> DataFrame:
    """Per detector, the seconds of the last scan scaled by the number of modules; (detector, seconds, modules) in."""
    return last.select("detector", F.round(F.col("seconds") * modules_now / F.greatest(F.col("modules"), F.lit(1)), 6).alias("predicted"))
