"""Record files as a stream: each new file once, with progress in a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.decode import decode_long
from ..plans.schema import Plan
from ..sources.records import cut_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def record_stream(spark: SparkSession, folder: str, length: int, files_per_batch: int = 100) -> DataFrame:
    """(src_file, record_index, rec) of fixed-width files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return cut_files(files, length)


def decode_stream(spark: SparkSession, folder: str, plan: Plan, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Decode what has arrived into Parquet and stop; a restart goes on after the last finished batch.

    This is the RERUN of a batch program: state is the checkpoint's list of files, so a batch that
    broke off is read again as a whole. A batch's output folder is overwritten, so it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = decode_long(batch, plan)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(rows, number)

    records = record_stream(spark, folder, plan.record_length or plan.max_length)
    query = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query
