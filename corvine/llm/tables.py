"""How the operators reach their inputs and cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This session's part of the folder that the cluster names in spark.checkpoint.dir; a folder of our own only in a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvine-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether an execution's shuffle files go at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: later stages read it, whichever executors are lost.

    What was shuffled for it is not read again and goes at once, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        # The setting holds for plans made under it, hence the new one.
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(RELEASE, before)


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by the CRC of its id; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def slots(rows: int, per_slot: int) -> int:
    """How many parts keep each part near ``per_slot``."""
    return max(1, -(-int(rows) // per_slot))


#: Rows of some 16 bytes that are broadcast at most; beyond it joins shuffle. Rows of one key that one task takes about.
BROADCAST_ROWS, PER_TASK = 2_000_000, 2_000


def frequent(rows: DataFrame, key: str, per_task: int = PER_TASK) -> DataFrame:
    """key, salts: how many tasks share the rows of each value of ``key`` that has over ``per_task`` of them; counted before the shuffle."""
    return cut(rows.groupBy(key).agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts")).filter("salts > 1"))


def spread_join(rows: DataFrame, right: DataFrame, key: str, other: str, hot: DataFrame) -> DataFrame:
    """rows joined with right by ``key``; rows of a frequent key are dealt by a hash of ``other``, and its few right rows copied to each of their tasks."""
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    salts = F.coalesce(F.col("salts"), F.lit(1))
    copied = right.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
    return dealt.join(copied, [key, "salt"]).drop("salt")
