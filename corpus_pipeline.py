"""From documents to packed windows: stages over a table of documents, each written and read again by the next.

Stages take (spark, docs, sf_dir) and return the columns of documents (doc_id, text, lang, source, n_chars), the last
one the packed pieces.

A row without a doc_id is a document of its own.  The first stage sees to it that a doc_id names one text: of unlike texts under
one doc_id, the one with the least hash keeps it and the others go on without.  So nothing is lost to a shared name in
run().  A later stage given such rows by itself takes a doc_id as the name of a document: near-dedup then keeps one row of it (the
one with the least hash), and a mix takes each of them alike.

In all stages: null text is empty text (the first stage drops it, as it drops what has no letter); repeated rows are copies;
texts of any length are taken whole; an empty table gives an empty one; columns beyond those of documents are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberloom.llm import langid, minhash, mixing, packing, suffixdedup
from fiberloom.scratch import join_checked, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this says that the text is in none of the learned languages.
LEAST_SCORE = 0.05
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id``: the doc_id, and for rows without one a number of their own that is no doc_id, settled once."""
    docs = docs.withColumn("_id", F.col("doc_id").cast("long"))
    ends = docs.agg(F.max("_id").alias("top"), F.count(F.when(F.col("_id").isNull(), 1)).alias("n")).first()
    if not ends["n"]:
        return docs
    bare = settle(docs.where("_id is null").drop("_id").withColumn("_place", F.monotonically_increasing_id()), "pipeline-bare")
    span = bare.agg(F.max("_place")).first()[0] + 1
    most, draw = (1 << 63) - 1, random.Random(17)
    # after all doc_ids, so that these name a class first; only if there is no room, where no doc_id lies
    firsts = [(ends["top"] if ends["top"] is not None else -1) + 1, *[draw.randrange(-most, most - span) for _ in range(20)]]
    for first in firsts:
        if first + span <= most and docs.where(F.col("_id").between(first, first + span)).isEmpty():
            return docs.where("_id is not null").unionByName(bare.withColumn("_id", F.col("_place") + F.lit(first)).drop("_place"))
    raise ValueError(f"no free range of {span} numbers among the doc_ids for the {ends['n']} rows without one")


def _one_text_an_id(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id null where another text under it has a lesser hash; hashes are counted by id, and only ids with several join."""
    seen = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_keeps"), F.max(F.xxhash64("text")).alias("_last"))
    several = settle(seen.where("_keeps <> _last").select("doc_id", "_keeps"), "pipeline-shared")
    if several.isEmpty():
        return docs
    told = join_checked(docs.select(*COLUMNS), several, "doc_id", "left", row_bytes=48, salt_by="text")
    return told.withColumn("doc_id", F.when(F.coalesce(F.xxhash64("text") == F.col("_keeps"), F.lit(True)), F.col("doc_id"))).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the predicted language; documents without letters or in no learned language go.

    Predictions depend on the text alone, and come back by its hash.
    """
    model, docs = langid.train(docs), _one_text_an_id(docs.select(*COLUMNS))
    if not model.langs:
        return docs
    of_text = F.xxhash64("text")
    told = langid.predict(docs.select(of_text.alias("doc_id"), "text"), model).withColumnRenamed("doc_id", "_id")
    told = told.groupBy("_id").agg(F.max_by("lang_pred", "score").alias("_lang"), F.max("score").alias("_score"))
    sure = settle(told.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).drop("_score"), "pipeline-languages")
    found = join_checked(docs.select(*COLUMNS).withColumn("_id", of_text), sure, "_id", row_bytes=48, salt_by="doc_id")
    return found.withColumn("lang", F.col("_lang")).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near copies stays; rows without one come after those with one."""
    named = _named(docs.select(*COLUMNS))
    classes = minhash.near_classes(named.select(F.col("_id").alias("doc_id"), "text"))
    stay = classes.where(F.col("doc_id") == F.col("class_id")).withColumnRenamed("doc_id", "_id")
    stay = settle(stay.groupBy("_id").agg(F.count("*").alias("_rows")), "pipeline-stay")
    found = join_checked(named, stay, "_id", row_bytes=24)
    first = found.where("_rows > 1").groupBy("_id").agg(F.min_by(F.struct(*COLUMNS), F.xxhash64("text", "lang", "source", "n_chars")).alias("_r")).select("_r.*")
    return found.where("_rows = 1").select(*COLUMNS).unionByName(first)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that stand earlier are cut out; a document with nothing left goes."""
    cut = suffixdedup.cut_repeats(docs, keep=("lang", "source"), with_text=True)
    left = cut.where((F.col("kept_text") != "") | (F.col("n_removed") == 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; what it takes in part is cut after as many words."""
    named = _named(docs.select(*COLUMNS))
    taken = mixing.mix(named, keep=("_id",)).groupBy("_id").agg(F.max("taken").alias("_taken"), F.max("size").alias("_size")).where("_taken > 0")
    found = join_checked(named, settle(taken, "pipeline-taken"), "_id", row_bytes=40)
    times = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    rows = found.withColumn("_nth", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_nth") - 1) * F.col("_size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("text", F.when(words < F.col("_size"), cut).otherwise(F.col("text")))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row with their windows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near-dedup", one_of_near_copies),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: None: the stages include a trained model, hashing by content and a packing search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
