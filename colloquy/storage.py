"""Intermediate tables in the folder that driver and executors share.

``stage`` cuts lineage with a written Parquet table in the session's
``spark.checkpoint.dir``; where that is unset, a local session gets a temporary
folder and any other an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's own folder below the shared checkpoint folder."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="colloquy-")
            sc.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/colloquy-{app}"
        atexit.register(_clean, spark, _roots[app])
    return _roots[app]


def _clean(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may already be gone when the interpreter ends
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a join side that may be broadcast after they have been counted.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``df`` (staged, narrow rows) as a broadcast side if its counted size allows.

    Beyond ``rows`` the frame is returned unhinted and the join shuffles.
    """
    return F.broadcast(df) if df.count() <= rows else df
