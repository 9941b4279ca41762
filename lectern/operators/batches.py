"""Bounds of the Arrow batches in which rows go to Python."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch at most; texts are long, and a worker holds a batch and its copies.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows that Spark's Parquet reader decodes at a time.
READ_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to these bounds, where they are larger."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"(\d+)[bB]?$", spark.conf.get(name))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def bounded_reads(spark: SparkSession) -> None:
    """Lowers the rows that the session's Parquet readers hold at a time; of 4,096 texts each task would keep buffers of their bytes, doubled as they grow."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ_ROWS:
        spark.conf.set(name, str(READ_ROWS))
