"""Shared intermediate tables, as in the rest of the library, and worker memory."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.storage import BROADCAST_ROWS, shared_root, small, stage

__all__ = ["BROADCAST_ROWS", "fresh", "modest_batches", "release", "shared_root", "small", "stage", "tidy", "trim"]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT, _MODEST = "67108864b", "6291456b"


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of 6 MB where the session has the default of 64 MB: each lives in the JVM and in a worker, in and out."""
    if spark.conf.get(_BATCH_BYTES, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH_BYTES, _MODEST)


def release() -> None:
    """Give freed memory back to the system at a task's end: workers live on and other stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trim(spark: SparkSession) -> None:
    """Have the driver's JVM give freed native memory back to the system.

    What its compiler threads free while they compile generated code stays in the allocator's
    arenas, and with hundreds of plans these come to more than the heap.
    """
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    of = jvm.java.lang.Class.forName

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    try:
        types = array(jvm.java.lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = of("javax.management.MBeanServer").getMethod("invoke", types)  # the server's own class is not exported
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))
    except Py4JError:  # another JVM or C library
        pass


def tidy(spark: SparkSession, executors: bool = False) -> None:
    """Let finished steps go: Spark drops their shuffle files and broadcasts once the driver's references are collected, and the driver gets smaller.

    With ``executors`` their JVMs collect in full too: a heap that a step
    filled goes back to the system, with the classes of its generated code and
    its direct buffers, before the next step's workers need the room. A task
    for each of them (the driver is counted too) and Spark's even dealing reach every idle one; a busy one may be left out.
    """
    release()
    sc = spark.sparkContext
    sc._jvm.System.gc()
    trim(spark)
    if executors and not sc._jsc.sc().isLocal():
        n = sc._jsc.sc().getExecutorMemoryStatus().size()
        collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
        spark.range(0, n, 1, n).select(collected).write.format("noop").mode("overwrite").save()
