"""Tables published whole: a new version is written beside the old one, and one small commit makes it the served one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.store import upsert

_COMMIT = "version long, path string, batch long"


class Published:
    """A table below ``root``, a folder that driver and executors share: ``data`` holds versions, ``commits`` one row for each that was finished.

    A commit is one file of one row that Spark's committer renames into place, after all data of its version is written; a reader sees it
    whole or not at all. A run that fails before leaves the old version served, and its data are never named by a commit. Commits name
    versions by number, so of two runs that publish the same number at once the second fails where the first has committed; one table
    should have one publisher. Old versions stay until ``superseded`` names them and the caller removes them: readers may be in them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> DataFrame:
        """Rows (version, path, batch); none before the first commit."""
        try:
            return self.spark.read.schema(_COMMIT).json(f"{self.root}/commits/*")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMIT)

    def _last(self, slot: int) -> tuple[int, str, int | None] | None:
        rows = self.commits().orderBy(F.desc("version")).limit(slot + 1).collect()
        return tuple(rows[slot]) if len(rows) > slot else None

    def read(self, slot: int = 0) -> DataFrame | None:
        """The current version, or with slot 1 the one before it; None if there is none."""
        last = self._last(slot)
        return self.spark.read.parquet(last[1]) if last else None

    def publish(self, rows: DataFrame, batch: int | None = None) -> int:
        """Write ``rows`` as the next version, commit it and return its number. ``rows`` may read the version served now."""
        last = self._last(0)
        version = last[0] + 1 if last else 1
        path = f"{self.root}/data/{version:012d}-{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(path)
        commit = self.spark.createDataFrame([(version, path, batch if batch is not None else (last[2] if last else None))], _COMMIT)
        commit.coalesce(1).write.mode("error").json(f"{self.root}/commits/{version:012d}")
        return version

    def merge(self, rows: DataFrame, key: str, order: str | None = None, batch: int | None = None) -> int:
        """Publish the served version with ``rows`` in place of old rows with their key; of a key's new rows the one of greatest ``order``.

        A batch number that is not above the last committed one was merged before a restart: nothing is written again.
        """
        last = self._last(0)
        if last and batch is not None and last[2] is not None and batch <= last[2]:
            return last[0]
        old = self.spark.read.parquet(last[1]) if last else rows.limit(0)
        return self.publish(upsert(old, rows, key, order), batch)

    def sink(self, key: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each batch is merged once, also when it is given again after a failure."""
        return lambda batch, number: (self.merge(batch, key, order, number), None)[1]

    def superseded(self, kept: int = 2) -> DataFrame:
        """Rows (version, path) of committed versions before the last ``kept``."""
        edge = self.commits().agg((F.max("version") - kept).alias("edge"))
        return self.commits().join(F.broadcast(edge), F.col("version") <= F.col("edge")).select("version", "path")
