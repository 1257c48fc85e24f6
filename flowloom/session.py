"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Settings of generated code that iterative and wide plans need, with the defaults that they replace. Methods beyond
#: 8000 bytes are left uncompiled by HotSpot and run interpreted, several times slower: such stages run operator by
#: operator instead, where the code is split. Without stage numbers in class names, repeated rounds of one plan share
#: their compiled code.
_CODE = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000"), "spark.sql.codegen.useIdInClassName": ("true", "false")}


def prepare(spark: SparkSession) -> None:
    """Set what _CODE lists; a value that somebody has set stays."""
    for name, (default, value) in _CODE.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Only a local master, as in tests, may do without: it gets one of its
    own; on a cluster executors would write to different disks, so a missing folder is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "flowloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


#: The tables that this process has written for itself.
_WRITTEN: list[str] = []


def table_path(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder, which clean() will delete."""
    _WRITTEN.append(f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clean(spark: SparkSession) -> int:
    """Delete the tables written by queries so far and return their number; for when their results have been used."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read it back.

    The table outlives any executor, starts from a fresh plan, and its true size lets small tables be broadcast. It
    stays until clean() is called.
    """
    spark = df.sparkSession
    path = table_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` written and counted: marked for broadcast if it has at most ``rows`` rows, to be joined by shuffle if more."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= rows else done


def spread(df: DataFrame, at_least: int) -> int:
    """Shuffle partitions to use for ``df``'s session, never fewer than ``at_least``."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
