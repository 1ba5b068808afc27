"""Where results go: versioned tables with a manifest, JSON lines, and a short Markdown report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiberloom.operators.incremental import input_digest

MANIFEST = "name string, version string, digest string, n long, bytes long, written timestamp"


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a table beside its version's place, move it there, then add the manifest row that makes it the latest.

    A version is named by its rows' digest; one that is there already is left as it is, so no reader sees a half-written one.
    """
    spark = df.sparkSession
    digest = input_digest(df)
    version = digest.replace("-", "_")[-40:]
    path = f"{root}/{name}/version={version}"
    staged = f"{root}/_staging/{name}-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm, context = spark._jvm, spark.sparkContext._jsc
    place, found = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    files = place.getFileSystem(context.hadoopConfiguration())
    if files.exists(place):
        files.delete(found, True)
    else:
        files.mkdirs(place.getParent())
        if not files.rename(found, place):
            raise OSError(f"{staged} could not be moved to {path}")
    n = spark.read.schema(df.schema).parquet(path).count()
    size = spark.read.format("binaryFile").load(path + "/*.parquet").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] if n else 0
    row = spark.createDataFrame([(name, version, digest, n, int(size))], "name string, version string, digest string, n long, bytes long")
    row.withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"{root}/_manifest")
    return version


def latest(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """The last published version; raises if it has other rows than were written."""
    row = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").where(F.col("name") == name).agg(F.max_by(F.struct("version", "n"), "written").alias("m")).first()["m"]
    if row is None:
        raise LookupError(f"{name} was never published")
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(f"{root}/{name}/version={row['version']}")
    if df.count() != row["n"]:
        raise ValueError(f"{name} has {df.count()} rows; {row['n']} were written")
    return df


def to_retire(manifest: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(name, version) beyond the ``most`` newest of each name or beyond the newest that fit ``most_bytes``."""
    w = Window.partitionBy("name").orderBy(F.desc("written"), "version")
    ranked = manifest.withColumn("_k", F.row_number().over(w)).withColumn("_sum", F.sum("bytes").over(w))
    return ranked.where((F.col("_k") > most) | ((F.col("_sum") > most_bytes) & (F.col("_k") > 1))).select("name", "version")


def json_report(findings: DataFrame, path: str, profile: str = "full") -> None:
    """JSON lines: whole findings, or (profile ``summary``) counts by detector."""
    out = findings if profile == "full" else findings.groupBy("detector").agg(F.count("*").alias("n")).orderBy("detector")
    out.write.mode("overwrite").json(path)


def markdown_report(findings: DataFrame, most: int = 25) -> str:
    """A report of the ``most`` findings with most places; the limit is the feature, the counts are of all."""
    counts = findings.groupBy("detector").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "detector").collect()
    top = findings.orderBy(F.desc("n"), "detector", "subject").limit(most).collect()
    lines = ["# Findings", "", "| detector | findings |", "|---|---|", *[f"| {r['detector']} | {r['n']} |" for r in counts], ""]
    for r in top:
        lines += [f"## {r['detector']}: {r['subject']}", "", f"{r['n']} places", "", *[f"- {e['path']}:{e['line']} {e['symbol']}" for e in r["evidence"]], ""]
    return "\n".join(lines)
