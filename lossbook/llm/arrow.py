"""mapInArrow with the package's sources at hand on every executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lossbook.session import ship


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Long texts make large batches: where the session has Spark's default of 10,000 rows a batch, 1,000 are sent from here on."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH, "10000") == "10000":
        df.sparkSession.conf.set(BATCH, "1000")
    return df.mapInArrow(run, schema)
