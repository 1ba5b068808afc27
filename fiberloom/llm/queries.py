"""The queries of this subpackage and their SQL, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiberloom.llm import digest, langid, linkrank, minhash, mixing, packing, quality, sql, suffixdedup, warc, xent


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_from_pages(_table(spark, sf_dir, "pages")), keep=("page_id",))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def op8_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what is labelled of good quality."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return xent.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.cut_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge_urls(_table(spark, sf_dir, "pages")).drop("trust", "distrust")


#: Not here: what a trained model, hashing by content or a search decides; those are tested against plain code.
SQL = sql.SQL
QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_warc, op4_language, op5_quality, op6_fingerprints, op7_near, op8_loss, op9_repeats, op10_urls)}
