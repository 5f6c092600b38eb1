"""Session helpers shared by all operators: lineage cuts and size-checked hand-over to executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that setting is absent (local tests) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tintero-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder.

    Files survive the loss of executors; nothing is kept on one machine only.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a side that is sent to every executor at most; beyond, the join shuffles.
HAND_OVER = 16 << 20


def bytes_of(df: DataFrame) -> int:
    """Bytes of all values of ``df``, by their JSON form; one pass, aggregated in the tasks."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def hand_over(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes are within ``limit``, else as it is (for a shuffle join).

    ``df`` should be materialised, as it is read once to be measured.
    """
    return F.broadcast(df) if bytes_of(df) <= (HAND_OVER if limit is None else limit) else df


#: Bytes of a table within which it is spread over the cores.
SPREAD = (1 << 20, 256 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder.

    A small table (at most 256 MB) that comes in fewer pieces than the session has
    cores is spread over them; larger tables are read as they are, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    low, high = SPREAD
    if low <= int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= high and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df
