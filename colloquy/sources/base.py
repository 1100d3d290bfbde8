"""What a source has to provide."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from ..schema import AdapterKind

#: Bytes of a file that detection looks at.
DETECTION_BYTES = 4096
#: Bytes of a file beyond which it is read in parts.
LARGE_FILE = 64 << 20


class Adapter(ABC):
    """Custom sources subclass this and pass their frame to the pipeline."""

    kind: AdapterKind

    @abstractmethod
    def detect(self, header: bytes) -> bool:
        """Whether the first bytes of a file look like this format."""

    @abstractmethod
    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Messages of the file(s), with a unique ``seq`` in input order."""


    def read_many(self, spark: SparkSession, path: str) -> DataFrame:
        """Messages of a folder of files, or of large ones; a source that can read them in parts says how."""
        return self.read(spark, path)


def survey(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The file to detect by, a folder's first one, and whether there may be much to read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    status = store.getFileStatus(where)
    if status.isFile():
        return path, status.getLen() > LARGE_FILE
    names = [s.getPath().toString() for s in store.listStatus(where) if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
    if not names:
        raise ValueError(f"no files in {path}")
    return min(names), True


def read_header(spark: SparkSession, path: str, size: int = DETECTION_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads; only they are fetched."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()
