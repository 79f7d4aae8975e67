"""Row-wise operators over Arrow batches: keep every column, append some."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of one Arrow batch of texts, in the executor's memory outside its heap and again in its
#: Python worker.  Spark's own bound is eight times that, for each task.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Small batches in this session, unless its user has set a bound."""
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: From a text column to one Arrow array for each new field, in the rows' order.
Columns = Callable[[pa.Array], list]


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Columns], drop_text: bool = False) -> DataFrame:
    """``df`` with ``fields`` computed from ``text_col``.

    ``make`` runs once in each task and returns the function for a batch, so that models are
    loaded once.  A column of ``df`` that has the name of a new field is replaced.  With
    ``drop_text`` the text itself goes no further than the task that reads it.
    """
    bounded_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    if text_col.lower() in new:
        raise ValueError(f"a new column would replace the text column {text_col}")
    base = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in new])
    at = base.columns.index(text_col)
    kept = [i for i in range(len(base.columns)) if not (drop_text and i == at)]
    schema = T.StructType([*(base.schema.fields[i] for i in kept), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            work = work or make()
            made = [pa.array(x, k) if not isinstance(x, pa.Array) else x.cast(k) for x, k in zip(work(b.column(at)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *made], names=names)

    return base.mapInArrow(run, schema)
