"""The folder that every executor can reach, and tables written there to cut lineage."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tarnlake.errors import LakeError
from tarnlake.sources.storage import local_path


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without one, a temporary folder that becomes it.

    A cluster without the setting is refused: a folder of one machine would be lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise LakeError("VALIDATION_ERROR", "spark.checkpoint.dir must name a folder all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends (results that last are written elsewhere)."""
    root = f"{shared_root(spark)}/tarnlake/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no recomputation of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each query that runs meanwhile as it ends, not when the driver happens to collect its garbage.

    For queries whose result is written (``materialized``) and read from there.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tasks(spark: SparkSession) -> int:
    """Tasks for work whose cost isn't in the bytes that are shuffled (paths of files, say), which AQE would put into few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs far more than moving the rows.

    A table of many files is left as it is; one that a few tasks would read is spread by the hash of its ``keys`` columns,
    which gives the same partitions when a lost one is computed again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


#: Schemes whose rename is atomic and refuses an existing name.
RENAMING = frozenset("hdfs viewfs abfs abfss ofs".split())


class Pointer:
    """Numbered pointer files ``CURRENT-<n>`` under ``root``; the highest number is in force.

    A pointer is written whole under another name and then takes its number, which fails if the number is taken: of two
    writers that saw the same pointer, one wins and the other is told. Local files take it by a hard link, others by a
    rename; object stores, whose rename is neither atomic nor exclusive, are refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        context = spark.sparkContext
        self._hadoop, self._configuration = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
        self._io = context._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(self._configuration)
        scheme = self._fs.getUri().getScheme()
        if scheme != "file" and scheme not in RENAMING:
            raise LakeError("VALIDATION_ERROR", "the store can't publish a pointer exclusively", {"scheme": scheme})

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def names(self, prefix: str = "", folder: str = "") -> list[str]:
        """The names in ``root``, or a folder of it, that begin with ``prefix``."""
        at = self._path(f"{self.root}/{folder}".rstrip("/"))
        if not self._fs.exists(at):
            return []
        return [n for s in self._fs.listStatus(at) if (n := s.getPath().getName()).startswith(prefix)]

    def current(self) -> dict | None:
        """The content of the pointer in force with its ``number``; None before the first."""
        numbers = [int(n.rpartition("-")[2]) for n in self.names("CURRENT-")]
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self.root}/CURRENT-{max(numbers):012d}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8")) | {"number": max(numbers)}
        finally:
            stream.close()

    def publish(self, content: dict, after: dict | None) -> dict:
        """Put ``content`` in force after the pointer ``after``; a ``COMMIT_CONFLICT`` if another writer did so first."""
        number = (after or {}).get("number", 0) + 1
        temporary, name = f"{self.root}/.pointer-{uuid.uuid4().hex}", f"{self.root}/CURRENT-{number:012d}"
        out = self._fs.create(self._path(temporary), True)
        out.write(json.dumps(content).encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(local_path(temporary), local_path(name))
            else:
                files = self._hadoop.FileContext.getFileContext(self._path(temporary).toUri(), self._configuration)
                none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
                files.rename(self._path(temporary), self._path(name), none)
        except Exception as e:
            if self._fs.exists(self._path(name)):
                raise LakeError("COMMIT_CONFLICT", "another writer has committed", {"number": number}) from e
            raise
        finally:
            self._fs.delete(self._path(temporary), False)
        return content | {"number": number}
