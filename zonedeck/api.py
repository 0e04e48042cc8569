"""Programs from their files: check() says what stands in the way, convert() gives something to run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .plans import machine, program


class ConversionError(ValueError):
    """A program with errors can't be converted; report says which."""

    def __init__(self, report: dict[str, Any]):
        super().__init__(f"not executed: {', '.join(report['errors'])}")
        self.report = report


@dataclass
class Converted:
    """A program that runs over DataFrames."""

    text: str
    report: dict[str, Any]
    programs: list[str] = field(default_factory=list)

    def over_rows(self, rows: DataFrame) -> DataFrame:
        return machine.execute(self.text, rows)

    def over_files(self, records: DataFrame, read: str, write: str | None = None, **more: Any) -> DataFrame:
        return machine.run_files(self.text, records, read, write, **more)


def check(path: str | Path, copybook_dirs: list[str | Path] | None = None, source_format: str = "auto") -> dict[str, Any]:
    """The report of a source: errors, risky constructs, copybooks and calls."""
    return _read(path, copybook_dirs, source_format)[1]


def _read(path, copybook_dirs, source_format) -> tuple[str, dict[str, Any]]:
    source = program.preprocess(path, copybook_dirs, source_format)
    got = program.analyze(source.text)
    errors = sorted(verb for verb, (status, _) in got["verbs"].items() if status != "executed")
    report = {
        "status": "blocked" if errors else "review" if got["risks"] else "ok", "program": got["program"], "errors": errors, "risks": got["risks"],
        "includes": [book for book, _ in source.includes], "calls": got["calls"], "verbs": {verb: n for verb, (_, n) in sorted(got["verbs"].items())},
    }
    return source.text, report


def convert(path: str | Path, copybook_dirs: list[str | Path] | None = None, source_format: str = "auto") -> Converted:
    text, report = _read(path, copybook_dirs, source_format)
    if report["errors"]:
        raise ConversionError(report)
    found = machine.programs(text)
    library = {p.name: p for p in found}
    for p in found:
        machine.Machine(p, library)
    return Converted(text, report, [p.name for p in found])


RUNNER = '''"""Runs the converted program: python run.py ROWS.parquet OUT.parquet"""

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from zonedeck.plans import machine

spark = SparkSession.builder.getOrCreate()
source = Path(__file__).with_name("program.cbl").read_text(encoding="utf-8")
machine.execute(source, spark.read.parquet(sys.argv[1])).write.parquet(sys.argv[2])
'''


def write_project(converted: Converted, folder: str | Path) -> list[Path]:
    """The expanded source, a script that runs it, and the report, in a folder."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    files = {"program.cbl": converted.text, "run.py": RUNNER, "report.json": json.dumps(converted.report, indent=1, sort_keys=True)}
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return [folder / name for name in files]
