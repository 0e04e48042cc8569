"""Queries of schemas, copybooks, program sources, bindings and reports."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import programs, reports
from ..plans import copybook, program
from ..plans import schema as plans
from ..sources import binding
from .registry import query, table

TOML = """version = 2
record_length = 9
on_error = "fail"
[[layout]]
kind = "field"
name = "ACCOUNT-NAME"
offset = 0
field_type = "alphanumeric"
length = 3
[[layout]]
kind = "field"
name = "BALANCE"
offset = 3
field_type = "packed-decimal"
total_digits = 11
scale = 2
signed = true
"""


@query("SELECT TRUE AS same_hash, 2 AS fields, 'E_SCHEMA' AS error FROM range(1)")
def schema_load(spark, d):
    """JSON and TOML of one schema; one that can't be planned."""
    import tomllib

    a, b = plans.load(TOML, "toml"), plans.load(json.dumps(tomllib.loads(TOML), indent=1))
    try:
        plans.load({"version": 3})
        error = None
    except plans.SchemaError as e:
        error = e.code
    return spark.createDataFrame([(a.semantic_hash == b.semantic_hash, len(b.fields), error)], "same_hash boolean, fields int, error string")


@query("""SELECT * FROM (VALUES ('ACCOUNT-NAME', 0, 3, 'alphanumeric'), ('BALANCE', 3, 4, 'packed-decimal'), ('TXN-COUNT', 7, 2, 'binary'), ('RATE', 9, 5, 'zoned-decimal')) t(path, start, length, kind)""")
def copybook_import(spark, d):
    """A flat copybook as a schema."""
    text = "01 REC.\n   05 ACCOUNT-NAME PIC X(03).\n   05 BALANCE PIC S9(5)V99 COMP-3.\n   05 TXN-COUNT PIC 9(04) COMP.\n   05 RATE PIC S9(3)V99.\n"
    plan = plans.load(copybook.to_schema(text))
    return spark.createDataFrame([(f.path, f.offset, f.length, f.codec.kind) for f in plan.fields], "path string, start int, length int, kind string")


@query("""SELECT * FROM (VALUES (1, 'IDENTIFICATION DIVISION.'), (2, 'PROGRAM-ID. DEMO.'), (3, '01 CUST-REC.'), (4, '05 NEW-ID PIC 9.'), (5, 'DISPLAY "a literal that goes on here".'), (6, 'MOVE BB TO AAX.')) t(n, line)""")
def source_expansion(spark, d):
    """Fixed form, continuation, comments, COPY REPLACING and REPLACE; sources are small and read on the driver."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "BOOK.cpy").write_text("       01 :P:-REC.\n       05 OLD-ID PIC 9.\n")
        Path(folder, "main.cbl").write_text(
            '000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. DEMO.\n000300* a comment\n000400 COPY BOOK REPLACING ==:P:== BY ==CUST== LEADING OLD BY NEW.\n'
            '000500     DISPLAY "a literal that goes on\n000600-    " here".\n000700     REPLACE ==AA== BY ==BB==.\n000800     MOVE AA TO AAX.\n'
        )
        lines = [line.strip() for line in program.preprocess(Path(folder, "main.cbl")).text.splitlines() if line.strip()]
    return spark.createDataFrame(list(enumerate(lines, 1)), "n int, line string")


def program_texts(spark, d) -> DataFrame:
    """(path, text): a program for each order, some with verbs that aren't executed."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("PROGRAM-ID. P"), k.cast("string"), F.lit(".\nCOPY "), F.col("o_orderstatus"), F.lit('.\nPARA-1.\n    CALL "SUB".\n'),
        F.when(F.pmod(k, F.lit(3)) == 0, "    ACCEPT X.\n    ACCEPT Y.\n").otherwise(""), F.when(F.pmod(k, F.lit(5)) == 0, "    ALTER PARA-1 TO PROCEED TO PARA-2.\n").otherwise(""),
        F.when(F.pmod(k, F.lit(7)) == 0, "    EXEC SQL.\n").otherwise(""),
    )
    return table(spark, d, "orders").select(k.cast("string").alias("path"), text.alias("text"))


@query("""SELECT 'blocked' AS section, 'verb.blocked' AS code, count(*) AS sources, CAST(2 * count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'unsupported', 'verb.rejected', count(*), count(*) FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 'review', 'procedure.alter', count(*), count(*) FROM orders WHERE o_orderkey % 5 = 0""")
def report_sections(spark, d):
    """Diagnostics by section, each once a source."""
    return reports.sections(programs.diagnostics(program_texts(spark, d)))


@query("SELECT count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0) AS ok, count(*) FILTER (o_orderkey % 3 = 0 OR o_orderkey % 7 = 0) AS blocked FROM orders")
def batch_totals(spark, d):
    """Sources with and without an error."""
    return programs.batch_totals(program_texts(spark, d))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'blocked' WHEN o_orderkey % 5 = 0 THEN 'review' ELSE 'ok' END AS status,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS errors, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings, o_orderstatus AS include, CAST(1 AS BIGINT) AS calls FROM orders""")
def migration_report(spark, d):
    """The report of each source, through its JSON."""
    texts = program_texts(spark, d)
    got = reports.migration_report(texts, programs.diagnostics(texts), programs.dependency_edges(texts))
    read = lambda key: F.get_json_object("report", f"$.{key}")
    return got.select("path", read("status").alias("status"), read("errors").cast("bigint").alias("errors"), "warnings", read("includes[0]").alias("include"), read("calls").cast("bigint").alias("calls"))


@query("""SELECT 'unexpected' AS side, c_name || '!' AS line FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'missing', c_name FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'missing', 'twice' FROM range(1)""")
def golden_compare(spark, d):
    """Lines that only the recorded or only the new output has, with multiplicity."""
    c = table(spark, d, "customer")
    twice = spark.createDataFrame([("twice",), ("twice",)], "line string")
    golden = c.select(F.col("c_name").alias("line")).union(twice)
    actual = c.select(F.concat("c_name", F.when(F.pmod("c_custkey", F.lit(10)) == 0, "!").otherwise("")).alias("line")).union(twice.limit(1))
    return reports.golden_differences(actual, golden).select("side", "line")


@query("""SELECT * FROM (VALUES ('MASTER', 'INPUT', TRUE, '00'), ('MASTER', 'INPUT', FALSE, '35'), ('MASTER', 'EXTEND', FALSE, '35'), ('MASTER', 'RANDOM', TRUE, '90'), ('RATES', 'OUTPUT', TRUE, '37'), ('RATES', 'INPUT', TRUE, '00'), ('FRESH', 'OUTPUT', TRUE, '37'), ('FRESH', 'OUTPUT', FALSE, '00'),
  ('LOG', 'EXTEND', FALSE, '00'), ('LOG', 'I-O', TRUE, '00'), ('INDEXED', '-', FALSE, 'E_CONFIG'), ('-', 'path', FALSE, '/other')) t(name, mode, exists_, status)""")
def file_bindings(spark, d):
    """A file map, how its files may be opened, another path for a name, an organization that can't be bound."""
    files = [{"name": n, "path": f"/{n}", "record_length": 80, "disposition": p} for n, p in (("MASTER", "old"), ("RATES", "shared"), ("FRESH", "new"), ("LOG", "mod"))]
    bound = binding.load(json.dumps({"files": files}), binding.named(["MASTER=/other"]))
    asked = [("MASTER", "INPUT", True), ("MASTER", "INPUT", False), ("MASTER", "EXTEND", False), ("MASTER", "RANDOM", True), ("RATES", "OUTPUT", True), ("RATES", "INPUT", True), ("FRESH", "OUTPUT", True), ("FRESH", "OUTPUT", False), ("LOG", "EXTEND", False), ("LOG", "I-O", True)]
    rows = [(n, mode, there, bound[n].status(mode, there)) for n, mode, there in asked]
    try:
        binding.load(json.dumps({"files": [{"name": "INDEXED", "record_length": 8, "organization": "indexed"}]}))
    except binding.BindingError as e:
        rows.append(("INDEXED", "-", False, e.code))
    rows.append(("-", "path", False, bound["MASTER"].path))
    return spark.createDataFrame(rows, "name string, mode string, exists_ boolean, status string")
