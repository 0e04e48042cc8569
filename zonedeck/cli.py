"""Command line: python -m zonedeck.cli COMMAND ...

Exit codes: 0 fine, 1 bad data, 2 bad arguments or schema, 3 input or output, 4 anything else.
"""

from __future__ import annotations

import argparse
import json
import sys
from decimal import Decimal, InvalidOperation
from pathlib import Path

from . import api
from .plans import copybook, schema
from .sources import binding

OK, DATA, CONFIG, IO, INTERNAL = range(5)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("zonedeck").getOrCreate()


def _shape(a: argparse.Namespace):
    from .functions.packed import Packed

    return Packed(a.digits, a.scale, not a.unsigned, a.mode)


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _field_bytes(a: argparse.Namespace, length: int) -> bytes:
    """A field from exactly one of --hex, --file and standard input."""
    if sum((a.hex is not None, a.file is not None, a.stdin)) != 1:
        raise binding.BindingError("E_CONFIG: one of --hex, --file and --stdin is needed")
    if a.hex is not None:
        try:
            return bytes.fromhex(a.hex.removeprefix("0x"))
        except ValueError as e:
            raise _DataError("E_HEX", str(e)) from e
    if a.file is not None:
        with open(a.file, "rb") as f:
            f.seek(a.offset)
            return f.read(length)
    return sys.stdin.buffer.read(length + 1)


class _DataError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")


def _decode(a) -> int:
    from pyspark.sql import functions as F

    shape = _shape(a)
    got = _one(_session(), shape.decode(F.lit(_field_bytes(a, shape.byte_len))))
    if got["error_code"]:
        raise _DataError(got["error_code"], "the field can't be decoded")
    print(json.dumps({"value": str(got["value"]), "sign_nibble": got["sign_nibble"], "sign_class": got["sign_class"]}))
    return OK


def _encode(a) -> int:
    from pyspark.sql import functions as F

    try:
        value = Decimal(a.value)
    except InvalidOperation as e:
        raise _DataError("E_DECIMAL", a.value) from e
    got = _one(_session(), _shape(a).encode(F.lit(str(value)).cast("decimal(38,18)"), strict=a.strict))
    if got["error_code"]:
        raise _DataError(got["error_code"], "the value doesn't fit")
    print(bytes(got["bytes"]).hex().upper())
    return OK


def _inspect(a) -> int:
    from .sources.sinks import inspect

    print(json.dumps(inspect(_field_bytes(a, _shape(a).byte_len))))
    return OK


def _load(path: str) -> schema.Plan:
    return schema.load(Path(path).read_text(encoding="utf-8"), "toml" if path.endswith(".toml") else None)


def _records(spark, plan: schema.Plan, path: str):
    from .sources import records

    if plan.input_encoding == "hex":
        return records.hex_lines(spark, path)
    if plan.has_occurs:
        return records.odo_records(spark.read.format("binaryFile").load(path), plan)
    return records.fixed_width(spark, path, plan.record_length or plan.max_length)


def _batch(a) -> int:
    from .operators import audit, decode
    from .sources import records, sinks

    spark, plan = _session(), _load(a.schema)
    if a.input and not Path(a.input.removeprefix("file://")).exists() and "://" not in a.input:
        raise FileNotFoundError(a.input)
    if plan.input_encoding in ("jsonl", "csv"):
        cells = records.jsonl_cells(spark, a.input) if plan.input_encoding == "jsonl" else records.csv_cells(spark, a.input, [f.path for f in plan.fields])
        rows = records.cell_rows(cells, plan, a.action == "verify")
        bad = rows.filter("NOT valid").count()
    else:
        found = _records(spark, plan, a.input)
        rows = decode.decode_long(found, plan, a.action == "verify", max_records=a.max_records)
        if plan.on_error == "fail":
            decode.stop_at_error(rows)
        bad = rows.filter("NOT valid").count()
    if a.action == "decode" and a.output:
        sinks.write_rows(rows, a.output, a.format)
    elif plan.input_encoding not in ("jsonl", "csv"):
        print(sinks.audit_json(audit.report(found, plan, True, a.sample_failures, a.max_records)))
    return DATA if bad else OK


def _schema(a) -> int:
    if a.action == "check":
        plan = _load(a.path)
        print(json.dumps({"fields": len(plan.fields), "record_length": plan.record_length, "semantic_hash": plan.semantic_hash, "coverage": plan.coverage()}))
    elif a.action == "from-copybook":
        print(json.dumps(copybook.to_schema(Path(a.path).read_text(encoding="utf-8")), indent=2))
    else:
        changes = schema.compare(_load(a.path), _load(a.other))
        print(json.dumps(changes))
        return DATA if changes else OK
    return OK


def _program(a) -> int:
    if a.command == "check":
        report = api.check(a.input, a.copybook_dir, a.source_format)
        print(json.dumps(report))
        return DATA if report["errors"] else OK
    try:
        converted = api.convert(a.input, a.copybook_dir, a.source_format)
    except api.ConversionError as e:
        print(json.dumps(e.report))
        return DATA
    if a.out:
        api.write_project(converted, a.out)
    print(json.dumps(converted.report | {"programs": converted.programs}))
    return OK


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="zonedeck")
    commands = out.add_subparsers(dest="command", required=True)
    for name, run in (("decode", _decode), ("encode", _encode), ("inspect", _inspect)):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--digits", type=int, required=True)
        p.add_argument("--scale", type=int, default=0)
        p.add_argument("--unsigned", action="store_true")
        p.add_argument("--mode", default="pfd")
        if name == "encode":
            p.add_argument("--value", required=True)
            p.add_argument("--strict", action="store_true")
        else:
            p.add_argument("--hex")
            p.add_argument("--file")
            p.add_argument("--offset", type=int, default=0)
            p.add_argument("--stdin", action="store_true")
    for name, actions in (("batch", ("decode", "verify")), ("profile", None)):
        p = commands.add_parser(name)
        p.set_defaults(run=_batch)
        if actions:
            p.add_argument("action", choices=actions)
        else:
            p.set_defaults(action="verify")
        for option in ("schema", "input"):
            p.add_argument(f"--{option}", required=True)
        p.add_argument("--output")
        p.add_argument("--format", default="jsonl")
        p.add_argument("--max-records", type=int)
        p.add_argument("--sample-failures", type=int, default=25)
    p = commands.add_parser("schema")
    p.set_defaults(run=_schema)
    p.add_argument("action", choices=("check", "from-copybook", "compare"))
    p.add_argument("path")
    p.add_argument("other", nargs="?")
    for name in ("convert", "check"):
        p = commands.add_parser(name)
        p.set_defaults(run=_program)
        p.add_argument("--input", required=True)
        p.add_argument("--copybook-dir", action="append", default=[])
        p.add_argument("--source-format", default="auto")
        p.add_argument("--out")
    return out


def main(argv: list[str] | None = None) -> int:
    from .operators.decode import DataError

    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return OK if not e.code else CONFIG
    try:
        return a.run(a)
    except (DataError, _DataError) as e:
        code, error = DATA, e
    except (schema.SchemaError, binding.BindingError, ValueError) as e:
        code, error = IO if str(e).startswith("E_SOURCE_IO") else CONFIG, e
    except OSError as e:
        code, error = IO, e
    except Exception as e:  # noqa: BLE001  (the command line's last resort: its exit code)
        code, error = INTERNAL, e
    print(error, file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
