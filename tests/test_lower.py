"""Row-local programs over DataFrames."""

from decimal import Decimal

import pytest

from zonedeck.plans import lower, program

HEAD = """IDENTIFICATION DIVISION.
PROGRAM-ID. P.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 QTY PIC 9(3).
01 PRICE PIC S9(5)V99 COMP-3.
01 TOTAL PIC S9(7)V99 COMP-3 VALUE 0.
01 SMALL PIC 9(2) VALUE 42.
01 GRADE PIC X(5) VALUE SPACES.
01 KIND PIC X.
88 IS-A VALUE "A".
88 IS-LETTER VALUE "A" THRU "Y".
01 N PIC S9(3) VALUE 0.
PROCEDURE DIVISION.
"""


def go(spark, body, rows, columns="qty int, price decimal(7,2), kind string"):
    return lower.run(HEAD + body, spark.createDataFrame(rows, columns)).collect()


def test_branches_and_arithmetic(spark):
    body = """MAIN.
    COMPUTE TOTAL ROUNDED = QTY * PRICE * 1.105
    IF TOTAL > 1000 AND NOT IS-A THEN MOVE "HIGH" TO GRADE
    ELSE IF IS-A MOVE "A-ONE-MORE" TO GRADE ELSE MOVE "LOW" TO GRADE END-IF END-IF.
    ADD QTY TO SMALL ON SIZE ERROR MOVE -1 TO N NOT ON SIZE ERROR ADD 1 TO N END-ADD.
    PERFORM SHOW 2 TIMES.
    IF N IS NEGATIVE STOP RUN.
    SUBTRACT 1 FROM N GIVING N.
    GOBACK.
SHOW.
    DISPLAY "Q=" QTY " N=" N.
"""
    got = go(spark, body, [(10, Decimal("200.00"), "B"), (70, Decimal("1.00"), "A")])
    a, b = got
    assert (a.TOTAL, a.GRADE, a.SMALL, a.N) == (Decimal("2210.00"), "HIGH ", 52, 0)
    assert (b.TOTAL, b.GRADE, b.SMALL, b.N) == (Decimal("77.35"), "A-ONE", 42, -1)
    assert a.display == ["Q=010 N=001"] * 2 and b.display == ["Q=070 N=-001"] * 2


def test_evaluate_set_and_size_errors(spark):
    body = """    EVALUATE QTY ALSO KIND
      WHEN 1 THRU 5 ALSO "A" MOVE "FEW-A" TO GRADE
      WHEN 1 THRU 5 ALSO ANY
      WHEN 9 ALSO ANY MOVE "FEW" TO GRADE
      WHEN OTHER MOVE ALL "X" TO GRADE
    END-EVALUATE.
    COMPUTE SMALL = QTY * 30.
    COMPUTE SMALL = PRICE.
    EVALUATE TRUE WHEN IS-A MOVE 1 TO N WHEN IS-LETTER MOVE 2 TO N WHEN OTHER SET IS-A TO TRUE END-EVALUATE.
"""
    got = go(spark, body, [(3, Decimal("1.50"), "A"), (9, Decimal("7.00"), "C"), (2, Decimal("0.10"), "Z"), (50, Decimal("0.10"), "z")])
    assert [(r.GRADE, int(r.SMALL), int(r.N), r.KIND) for r in got] == [("FEW-A", 90, 1, "A"), ("FEW  ", 7, 2, "C"), ("FEW  ", 60, 0, "A"), ("XXXXX", 42, 0, "A")]


def test_moves_and_errors(spark):
    got = go(spark, "    MOVE 1234 TO QTY. MOVE QTY TO GRADE. MOVE ZEROS TO TOTAL.\n", [(1, Decimal("1"), "x")])[0]
    assert (int(got.QTY), got.GRADE, got.TOTAL) == (234, "234  ", 0)
    with pytest.raises(Exception, match="CBL-RT-DECIMAL"):
        go(spark, "    MOVE 123456 TO PRICE.\n", [(1, Decimal("1"), "x")])
    for body in ("    GO TO X.\n", "    PERFORM A UNTIL QTY > 3.\n", "    MOVE 1 TO NOWHERE.\n", '    IF QTY = "A" MOVE 1 TO N.\n', "    COMPUTE N = QTY ** 2.\n", "    ACCEPT QTY.\n"):
        with pytest.raises(program.SourceError):
            go(spark, body, [(1, Decimal("1"), "x")])
