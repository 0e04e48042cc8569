"""Analyses of many program sources as DataFrames, and a registry of callable transformations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.program import analyze


def dependency_edges(sources: DataFrame) -> DataFrame:
    """(path, program, kind, target, line) from (path, text): kind is copy, call or dynamic-call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = analyze(text or "")
                rows += [(path, got["program"], "copy", b, None) for b in got["copybooks"]]
                rows += [(path, got["program"], "call" if c["literal"] else "dynamic-call", c["target"], c["line"]) for c in got["calls"]]
            kinds = [pa.string()] * 4 + [pa.int32()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "program", "kind", "target", "line"])

    return sources.select("path", "text").mapInArrow(run, "path string, program string, kind string, target string, line int")


def diagnostics(sources: DataFrame) -> DataFrame:
    """(path, code, severity, subject, n): verbs that aren't executed, and risky constructs by paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = analyze(text or "")
                rows += [(path, f"verb.{status}", "error", verb, n) for verb, (status, n) in sorted(got["verbs"].items()) if status != "executed"]
                rows += [(path, risk, "warning", p, 1) for risk, ps in got["risks"].items() for p in ps]
            kinds = [pa.string()] * 4 + [pa.int32()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "code", "severity", "subject", "n"])

    return sources.select("path", "text").mapInArrow(run, "path string, code string, severity string, subject string, n int").dropDuplicates()


def batch_totals(sources: DataFrame) -> DataFrame:
    """(ok, blocked): sources without and with an error."""
    bad = diagnostics(sources).filter("severity = 'error'").select("path").distinct().withColumn("bad", F.lit(True))
    return sources.select("path").join(bad, "path", "left").agg(F.count_if(F.col("bad").isNull()).alias("ok"), F.count_if("bad").alias("blocked"))


class Registry:
    """CALL: names to functions of DataFrames."""

    def __init__(self) -> None:
        self._programs: dict[str, tuple[Callable[..., DataFrame], int]] = {}

    def add(self, name: str, function: Callable[..., DataFrame], using: int = 0) -> None:
        if any(c in name for c in "/\\.") or not name:
            raise ValueError("CBL-RT-NESTED-PROGRAM: not a program name")
        self._programs[name.upper()] = function, using

    def call(self, name: str, rows: DataFrame, *using, dynamic: bool = False) -> DataFrame:
        """A missing program raises; a missing dynamic one leaves the rows as they are."""
        found = self._programs.get(name.upper())
        if found is None:
            if dynamic:
                return rows
            raise ValueError(f"CBL-RT-NESTED-PROGRAM: {name}")
        if len(using) != found[1]:
            raise ValueError(f"CBL-RT-NESTED-PROGRAM: {name} takes {found[1]} arguments")
        return found[0](rows, *using)
