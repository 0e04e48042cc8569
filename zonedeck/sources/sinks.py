"""Sinks: long rows as JSON lines or CSV, audit reports, fixed-width files, tape images."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import TAPE_MAGIC, tape_block
from .shared import opened

#: Fixed value: rows that one JSON document may hold.
MAX_JSON_ROWS = 100_000


def write_rows(rows: DataFrame, path: str, form: str = "jsonl", mode: str = "errorifexists") -> None:
    """Long rows by Spark's own writers; OPEN OUTPUT is mode overwrite, OPEN EXTEND append."""
    if form not in ("jsonl", "csv", "parquet"):
        raise ValueError(f"E_CONFIG: unknown output {form}")
    rows = rows.drop("pos")
    if form == "jsonl":
        rows.write.mode(mode).json(path, ignoreNullFields=False)
    elif form == "csv":
        rows.write.mode(mode).csv(path, header=True)
    else:
        rows.write.mode(mode).parquet(path)


def json_document(rows: DataFrame) -> str:
    """All rows as one JSON array; more than MAX_JSON_ROWS are refused."""
    some = rows.drop("pos").limit(MAX_JSON_ROWS + 1).toJSON().collect()
    if len(some) > MAX_JSON_ROWS:
        raise ValueError("E_OUTPUT_LIMIT: too many rows for one JSON document")
    return "[" + ",".join(some) + "]"


def audit_json(report: dict[str, Any]) -> str:
    return json.dumps(report, sort_keys=True, default=str)


def audit_csv(report: dict[str, Any]) -> str:
    """One line of totals, with the number of different codes and fields."""
    flat = {k: v for k, v in report.items() if not isinstance(v, (dict, list))}
    flat |= {"distinct_error_codes": len(report["error_distribution"]), "distinct_fields": len(report["field_profiles"])}
    return ",".join(flat) + "\n" + ",".join("" if v is None else str(v) for v in flat.values()) + "\n"


def inspect(data: bytes) -> dict[str, Any]:
    """Nibbles and sign of one packed field."""
    h = data.hex().upper()
    sign = h[-1:] or None
    return {"nibbles": list(h), "sign_nibble": sign and f"0x{sign}", "negative": sign in ("B", "D"), "byte_len": len(data)}


def write_fixed_width(records: DataFrame, path: str, order: str = "record_index") -> None:
    """Records (of any length) as binary parts in record order: rows are ranged by their index, and each task writes the bytes of its range.

    The parts' names sort in record order, so reading the folder by name gives the file back. `path` is a
    folder, or an address that pyarrow knows, which every executor reaches.
    """
    _write_parts(records.repartitionByRange(order).sortWithinPartitions(order), path, lambda rec: rec)


def write_tape(records: DataFrame, path: str, order: str = "record_index") -> None:
    """A folder with the whole image in one file: a tape is one sequence, which one task writes block by block."""
    _write_parts(records.repartition(1).sortWithinPartitions(order), path, tape_block, TAPE_MAGIC)


def _write_parts(ordered: DataFrame, path: str, form: Callable[[bytes], bytes], head: bytes = b"") -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        files, folder = opened(path)
        own = f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with files.open_output_stream(own) as f:
            f.write(head)
            for batch in batches:
                for rec in batch.column(0).to_pylist():
                    f.write(form(rec))
                    n += 1
        files.move(own, f"{folder}/part-{task.partitionId():05d}.bin")  # a task that runs again writes the same part anew
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    files, folder = opened(path)
    files.create_dir(folder, recursive=True)
    ordered.select("rec").mapInArrow(run, "n long").agg(F.sum("n")).collect()
