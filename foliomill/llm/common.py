"""Shared helpers: inputs, scratch tables in the cluster's shared folder, word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: space and the ASCII controls tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/foliomill"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    On a local master without that setting a folder under /tmp serves; on a cluster the setting is required.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/foliomill-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, keeps column pruning."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that are broadcast at most; beyond that both sides are shuffled.
BROADCAST_IDS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """name, led by as many underscores as make it no column of df (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in ids (one column, distinct; null equals null)."""
    name = fresh(docs, "_gone")
    gone = written(ids.toDF(name), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def words(text):
    """Column: the runs of non-blank characters of a text; null counts as empty."""
    clean = F.trim(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)))
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, " +"))


def word_count(text):
    """Column: how many words a text has, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
