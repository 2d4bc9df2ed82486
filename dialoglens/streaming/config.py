"""Configuration that changes while a stream runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dialoglens.operators.classify import usable_config
from dialoglens.operators.skew import MAX_CONFIG_ROWS
from dialoglens.session import delete_path, work_dir


class RefreshedConfig:
    """Reads a configuration for each micro-batch and keeps the rows of the last usable one.

    Rows are kept, not the plan: a file that is emptied, broken or deleted later doesn't touch them. Up to
    `MAX_CONFIG_ROWS` they are kept in the session, more of them as a copy in the shared folder, which the next usable
    configuration replaces. Only faults of reading and of content fall back; all others are raised.
    """

    def __init__(self, spark: SparkSession, read: Callable[[], DataFrame], usable: Callable[[DataFrame], bool] = usable_config):
        self._spark, self._read, self._usable = spark, read, usable
        self._good: DataFrame | None = None
        self._copy: str | None = None

    def _kept(self, candidate: DataFrame) -> tuple[DataFrame, str | None]:
        few = candidate.limit(MAX_CONFIG_ROWS + 1).toArrow()
        if few.num_rows <= MAX_CONFIG_ROWS:
            return self._spark.createDataFrame(few, candidate.schema), None
        path = f"{work_dir(self._spark)}/config-{uuid.uuid4().hex}"
        candidate.write.parquet(path)
        return self._spark.read.schema(candidate.schema).parquet(path), path

    def current(self) -> DataFrame:
        try:
            kept, copy = self._kept(self._read())
            gone = copy
            if self._usable(kept):
                gone, self._good, self._copy = self._copy, kept, copy
            if gone:
                delete_path(self._spark, gone)
        except (AnalysisException, SparkRuntimeException, Py4JJavaError):
            if self._good is None:
                raise
        if self._good is None:
            raise ValueError("no usable configuration yet")
        return self._good


def enrich_stream(
    texts: DataFrame, config: RefreshedConfig, enrich: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Apply `enrich(batch, configuration)` with the configuration of the moment."""

    def write(batch: DataFrame, batch_id: int) -> None:
        enrich(batch, config.current()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = texts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()
