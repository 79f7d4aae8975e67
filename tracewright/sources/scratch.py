"""Tables between the steps of one operator, in the folder that all executors share.

A written table is a cut of the lineage that a lost executor does not undo.  ``Work.keep`` deletes what
a result no longer reads; what it does read stays until ``clear``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made here, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one of our own only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _OWN[spark.sparkContext.applicationId] = base
    return base


class Work:
    """Written tables of one run of an operator; a lost executor only costs the reading tasks.

    What a lazy result still reads must stay; the caller clears ``root`` once the result is written.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: set[str] = set()

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and read it again: a cut of the lineage that survives lost executors."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path  # for drop() and keep()
        self.paths.add(path)
        return out

    def clear(self) -> None:
        """Delete every table of this run; call it once its results are written elsewhere."""
        self.keep()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        self._delete(df._work_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables of this run but those that the result still reads."""
        for path in self.paths - {t._work_path for t in tables}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        if path in self.paths:
            self.paths.discard(path)
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
