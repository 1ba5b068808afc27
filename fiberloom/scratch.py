"""Shared scratch tables, size-checked joins and distributed numbering.

Every helper here keeps data on the executors.  What reaches the driver is a
count, a schema, or one row of totals.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times the stated row width stay below this.
BROADCAST_BYTES = 24 << 20
#: Copies of the smaller side in a salted join.
SALTS = 16
#: Tasks of one join of pairs, at most.
MOST_TASKS = 10_000


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fiberloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so that its lineage ends there.

    Lost executors then cost a reread of files, not a recomputation of the whole plan.  Who asks for one value of ``by``
    reads the files of that value alone.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/fiberloom/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing still to be computed reads."""
    for df in tables:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Whether ``df`` is small enough to copy to every executor: ``row_bytes`` a row and what its columns of no fixed width hold, measured now."""
    loose = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    loose += [F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("array", "map")]
    return (df.agg(F.sum(sum(loose, F.lit(row_bytes).cast("long")))).first()[0] or 0) <= BROADCAST_BYTES


def join_checked(left: DataFrame, right: DataFrame, on: str, how: str = "inner", row_bytes: int = 64, salt_by: str | None = None) -> DataFrame:
    """Join a large ``left`` to a settled ``right`` on one column that may be heavily skewed.

    ``right`` is counted first: below BROADCAST_BYTES it is broadcast, beyond that its rows are
    copied SALTS times and ``left`` is dealt over the copies by a hash of ``salt_by``.
    """
    if fits_broadcast(right, row_bytes):
        return left.join(F.broadcast(right), on, how)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by or on), F.lit(SALTS)))
    copied = right.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return dealt.join(copied, [on, "_salt"], how).drop("_salt")


def paired(rows: DataFrame, key: str, row_id: str, left: list, right: list, made: float, block: int, per_task: int) -> DataFrame:
    """Rows of one ``key`` met by each other: columns ``left`` of each beside columns ``right`` of each.

    Rows name in ``_n`` how many their key has, and ``made`` is the sum of _n * _n / 2 over keys.  A key's left rows are dealt over
    blocks of about ``block``, each of which meets all its right rows: a large key is the work of many tasks, and one right row in
    ``block`` pairs is copied.  The number of tasks follows the pairs, not the bytes of the rows.
    """
    blocks, tasks = F.ceil(F.col("_n") / block), int(min(max(made / per_task, 1), MOST_TASKS))
    one = rows.select(key, F.pmod(F.xxhash64(row_id), blocks).alias("_block"), *left)
    two = rows.select(key, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_block"), *right)
    return one.repartition(tasks, key, "_block").join(two.repartition(tasks, key, "_block"), [key, "_block"]).drop("_block")


def ordered_parts(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Settle ``df`` dealt by ranges of ``order``, with the part number in ``_part``: parts follow one another."""
    return settle(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_part", F.spark_partition_id()), label)


def number_rows(df: DataFrame, order: list[str], to: str, label: str = "numbered") -> DataFrame:
    """Number the rows 0, 1, ... in ``order`` (nulls last) without bringing them into one task.

    Only one count per part is gathered; ties between equal rows are numbered in any order.
    """
    parts = ordered_parts(df, order, label)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_last() for c in order])) - 1
    numbered = parts.withColumn("_within", within)
    return numbered.join(F.broadcast(starts), "_part").withColumn(to, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def running_sum(df: DataFrame, group: str, order: list[str], value: str, to: str, label: str = "running") -> DataFrame:
    """The sum of ``value`` over the rows of the group that come earlier in ``order`` (nulls last), without bringing a group into one task.

    Sums by part and group are all that meets; equal rows come in any order.
    """
    parts = ordered_parts(df, [group, *order], label)
    sums = parts.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settle(sums.select(group, "_part", before.alias("_start")).withColumn("_at", F.struct(group, "_part")).drop(group, "_part"), f"{label}-starts")
    within = Window.partitionBy("_part", group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0))).withColumn("_at", F.struct(group, "_part"))
    return join_checked(summed, starts, "_at", row_bytes=120).withColumn(to, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_at", "_part")


def next_value(df: DataFrame, key: str, to: str, label: str = "next") -> DataFrame:
    """For a table of distinct ``key`` values: the next larger one, and for the largest the smallest.

    Ranges of keys are looked through side by side; each part's first key (one row a part) links it to the part before.
    """
    parts = ordered_parts(df, [key], label)
    firsts = parts.groupBy("_part").agg(F.min(key).alias("_first"))
    follow = firsts.select("_part", F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.min("_first").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_follow"))
    return parts.join(F.broadcast(follow), "_part").withColumn(to, F.coalesce(F.lead(key).over(Window.partitionBy("_part").orderBy(key)), F.col("_follow"))).drop("_part", "_follow")
