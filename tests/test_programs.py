"""Program sources: formats, COPY, REPLACE, analyses."""

import pytest
from pyspark.sql import functions as F

from zonedeck.operators import programs
from zonedeck.plans import program

MAIN = """000100 IDENTIFICATION DIVISION.
000200 PROGRAM-ID. DEMO.
000300* a comment
000400 COPY BOOK REPLACING ==:P:== BY ==CUST== LEADING OLD BY NEW.
000500     DISPLAY "a literal that goes on
000600-    " here".
000700 PARA-1.
000800     ALTER PARA-1 TO PROCEED TO PARA-2.
000900     CALL "SUB1" USING X. CALL WS-NAME. ACCEPT X.
"""


def test_copy_and_replace(tmp_path):
    (tmp_path / "main.cbl").write_text(MAIN)
    (tmp_path / "BOOK.cpy").write_text("       01 :P:-REC.\n       05 OLD-ID PIC 9.\n")
    got = program.preprocess(tmp_path / "main.cbl")
    assert got.form == "fixed" and [b for b, _ in got.includes] == ["BOOK"]
    lines = got.text.splitlines()
    assert lines[2:4] == ["01 CUST-REC.", "05 NEW-ID PIC 9."]
    assert got.origins[2] == (str(tmp_path / "BOOK.cpy"), 1)
    assert 'DISPLAY "a literal that goes on here".' in got.text
    (tmp_path / "r.cbl").write_text("       REPLACE ==AA== BY ==BB==.\n       MOVE AA TO AAX.\n       REPLACE OFF.\n       MOVE AA TO C.\n")
    assert program.preprocess(tmp_path / "r.cbl").text.splitlines() == ["MOVE BB TO AAX.", "MOVE AA TO C."]


@pytest.mark.parametrize(("text", "code"), [("COPY NONE.", "E_COPY_NOT_FOUND"), ("COPY SELF.", "E_COPY_RECURSIVE"), ("COPY DUP.", "E_COPY_AMBIGUOUS"), ("REPLACE ==A== ==B==.", "E_REPLACE_MALFORMED"), ("COPY SELF REPLACING X.", "E_COPY_REPLACING_MALFORMED")])
def test_source_errors(tmp_path, text, code):
    (tmp_path / "m.cbl").write_text(f"       {text}\n")
    (tmp_path / "SELF.cpy").write_text("       COPY SELF.\n")
    (tmp_path / "DUP.cpy").write_text("x")
    (tmp_path / "DUP.inc").write_text("y")
    with pytest.raises(program.SourceError) as e:
        program.preprocess(tmp_path / "m.cbl")
    assert e.value.code == code


def test_analyses(spark):
    text = "\n".join(line[7:] for line in MAIN.splitlines() if line[6] != "*")
    df = spark.createDataFrame([("a", text), ("b", "DISPLAY 'ACCEPT'."), ("c", None)], "path string, text string")
    edges = {(r.path, r.kind, r.target) for r in programs.dependency_edges(df).collect()}
    assert edges == {("a", "copy", "BOOK"), ("a", "call", "SUB1"), ("a", "dynamic-call", "WS-NAME")}
    found = {(r.code, r.subject) for r in programs.diagnostics(df).collect()}
    assert ("verb.blocked", "ACCEPT") in found and ("procedure.alter", "PARA-1") in found
    assert tuple(programs.batch_totals(df).first()) == (2, 1)
    calls = programs.Registry()
    calls.add("DOUBLE", lambda rows, c: rows.withColumn(c, F.col(c) * 2), using=1)
    assert [r.id for r in calls.call("double", spark.range(3), "id").collect()] == [0, 2, 4]
    assert calls.call("GONE", spark.range(3), dynamic=True).count() == 3
    with pytest.raises(ValueError):
        calls.call("GONE", spark.range(3))
