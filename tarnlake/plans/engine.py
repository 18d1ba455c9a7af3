"""One way to open tables of any format: plan their files, scan them as a DataFrame, in batches or by row."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.plans.query import Lake
from tarnlake.sources import iceberg, readers


class AnyTable:
    """A table opened by ``load_table``."""

    def __init__(self, lake: Lake, format: str, location: str, options: dict[str, Any]):
        self.lake, self.format, self.location, self.options = lake, format, location, options

    def plan_files(self, where: X.Expr | None = None) -> list[dict]:
        """The files to read, with their bytes; ruled out by partition where that is possible."""
        if self.format == "iceberg":
            keep = {k: v for k, v in self.options.items() if k in ("snapshot_id", "as_of", "ref", "mode")}
            plan = iceberg.load_table(self.lake.spark, self.location).plan_files(where=where, **keep)
            return [{"path": f.path, "bytes": f.size, "partition": dict(f.partition)} for f in plan.data]
        q = self._query()
        return [{"path": p, "bytes": n, "partition": {}} for p, n in (q.where(where) if where is not None else q).files()]

    def _query(self):
        openers = {"parquet": self.lake.path, "hive": self.lake.hive, "csv": self.lake.csv, "json": self.lake.json}
        return openers[self.format](self.location, **self.options)

    def scan(self, select: list[str] | None = None, where: X.Expr | None = None) -> DataFrame:
        if self.format == "iceberg":
            return iceberg.load_table(self.lake.spark, self.location).scan(select, where, **self.options)
        q = self._query()
        q = q.select(*select) if select else q
        return (q.where(where) if where is not None else q).df()

    def scan_batches(self, size: int = 4096, **options: Any) -> Iterator[list[dict]]:
        return readers.read_batches(self.scan(**options), size)

    def scan_rows(self, **options: Any) -> Iterator[dict]:
        for batch in self.scan_batches(**options):
            yield from batch


def load_table(spark: SparkSession, location: str, format: str = "parquet", **options: Any) -> AnyTable:
    """A table of format parquet, hive, csv, json or iceberg; other formats are refused."""
    if format not in ("parquet", "hive", "csv", "json", "iceberg"):
        raise LakeError("INVALID_QUERY", f"unknown format {format}")
    return AnyTable(Lake(spark), format, location, options)
