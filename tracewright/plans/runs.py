"""Runs that can be stopped: records are published in batches, and a restarted run does what is left (PIP1, SNK3).

A run is a folder.  A batch's records are JSON lines in ``records/<batch>-<attempt>``; they count once the file
``commits/<batch>`` names them, which is put there whole, by one rename.  A batch that was stopped on its way has no such
file, and its half-written folder is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import save_records


class Run:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, str]:
        """Folder of records by batch."""
        p, fs = self._at("commits")
        if not fs.exists(p):
            return {}
        out: dict[str, str] = {}
        for n in sorted(s.getPath().getName() for s in fs.listStatus(p)):
            if not n.startswith((".", "_")):
                out.setdefault(*n.split("=", 1))  # of two that were put there at once, all readers take the same
        return out

    def commit(self, batch: str, folder: str) -> bool:
        """False if another attempt has committed the batch first; its records count then."""
        if batch in self.committed():
            return False
        whole, fs = self._at(f"commits/{batch}={folder}")
        part, _ = self._at(f"commits/.{uuid.uuid4().hex}")
        fs.create(part).close()
        return fs.rename(part, whole)

    def records(self, schema: str) -> DataFrame:
        """The records of all committed batches."""
        folders = [f"{self.path}/records/{f}" for f in sorted(self.committed().values())]
        return self.spark.read.schema(schema).json(folders) if folders else self.spark.createDataFrame([], schema)

    def resume(self, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], batches: int = 16) -> int:
        """Publish ``work`` of each batch of ``rows`` that is not committed; the number of batches done now.

        A batch is a range of hashes of ``key``, so the same rows fall into the same batch after a restart.  Rows whose ``key``
        has a committed record are left out, so rows that came to a committed batch later make a batch of their own, and a row in two
        attempts has one record.
        """
        done = self.committed()
        told = self.records(f"{key} {dict(rows.dtypes)[key]}").select(key).distinct()
        todo = rows.join(told, key, "left_anti") if done else rows
        split = todo.withColumn("_batch", F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).cast("int"))
        open_ = {r._batch for r in split.select("_batch").distinct().collect()}  # at most ``batches``
        attempt = sum(1 for n in done if "." in n)
        for b in sorted(open_):
            name = str(b) if str(b) not in done else f"{b}.{attempt + 1}"
            folder = f"{name}-{uuid.uuid4().hex[:12]}"
            save_records(work(split.where(F.col("_batch") == b).drop("_batch")), f"{self.path}/records/{folder}")
            self.commit(name, folder)
        return len(open_)
