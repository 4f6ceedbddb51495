"""Session helpers: checkpoint folder, table loading, size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure the session has a checkpoint folder and return it.

    The cluster's shared folder in ``spark.checkpoint.dir`` is used as it is.  Only a
    local master may do without that setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
        path = tempfile.mkdtemp(prefix="logosmill-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def _scratch(spark: SparkSession) -> str:
    """This application's folder below the checkpoint folder; removed when the program ends."""
    sc = spark.sparkContext
    path = f"{checkpoint_dir(spark)}/logosmill-{sc.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_remove, sc, path)
    return path


def _remove(sc, path: str) -> None:
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The lineage ends there and lost executors lose nothing.  A table is used rather than
    ``checkpoint()``, which carries the optimizer's size estimates and constraints
    along: over the rounds of an iterative operator these multiply until planning takes
    minutes.  A table's sizes are real ones, and its columns can be pruned.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000, max_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of ``max_bytes`` in all, as JSON, else unchanged.

    The check stops after ``max_rows + 1`` rows, so a large side costs little.
    """
    size = F.octet_length(F.to_json(F.struct("*"))).cast("bigint")
    n, held = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= max_rows and (held or 0) <= max_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as the session shuffles into, or as it has cores.

    For work that is heavy for its bytes: adaptive coalescing, which goes by bytes, would
    leave it to a few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
