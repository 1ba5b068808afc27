"""Facts folded from a stream of source files: each file is parsed once per content, the store keeps its latest facts.

Readers see only batches that the manifest names, and only with the number of rows it states.  A batch that is
run again writes the same folder and the same manifest rows, so retries do not double anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fiberloom.operators.incremental import to_recompute
from fiberloom.sources import code

MANIFEST = "path string, source_hash string, n_facts long, batch_id long"


def stream_modules(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, module, source, source_hash) of the .py files that come to stand under ``root``."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
    base = root.rstrip("/") + "/"
    full = F.expr("_metadata.file_path")
    path = F.expr(f"substring(_full, instr(_full, '{base}') + {len(base)})")
    return code.modules_from_rows(files.select(F.col("value").alias("source"), full.alias("_full")).withColumn("path", path))


def manifest(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{store}/manifest")


def fold_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Parse what the manifest does not know yet, write its facts, then the manifest rows that make them visible."""
    spark = batch.sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{store}/manifest/none")
    known = manifest(spark, store).where(F.col("batch_id") != batch_id)
    new = to_recompute(batch.dropDuplicates(["path"]), known)
    found = code.facts(new)
    found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store}/facts/batch={batch_id}")
    written = spark.read.parquet(f"{store}/facts/batch={batch_id}").groupBy("path").agg(F.count("*").alias("n_facts"))
    rows = new.select("path", "source_hash").join(written, "path", "left").select("path", "source_hash", F.coalesce("n_facts", F.lit(0)).cast("long").alias("n_facts"), F.lit(batch_id).cast("long").alias("batch_id"))
    rows.write.mode("overwrite").parquet(f"{store}/manifest/batch={batch_id}")


def fold(modules: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start folding a stream of modules into ``store``; with ``once`` it ends when all that is there is folded."""
    writer = modules.writeStream.foreachBatch(lambda batch, batch_id: fold_batch(batch, batch_id, store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_facts(spark: SparkSession, store: str) -> DataFrame:
    """The facts of the last folded content of each path; raises if a batch has other rows than its manifest says."""
    last = manifest(spark, store).groupBy("path").agg(F.max("batch_id").alias("batch_id"), F.max_by("n_facts", "batch_id").alias("n_facts"))
    facts = spark.read.option("basePath", f"{store}/facts").parquet(f"{store}/facts").drop("batch").join(last.select("path", "batch_id"), ["path", "batch_id"], "left_semi")
    told, there = last.agg(F.coalesce(F.sum("n_facts"), F.lit(0))).first()[0], facts.count()
    if told != there:
        raise ValueError(f"the manifest tells of {told} facts, {there} are there")
    return facts
