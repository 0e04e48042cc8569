"""The program machine: statements, storage, files, and how runs end."""

import json
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from zonedeck.plans import machine
from zonedeck.queries.programs import UPDATES, program_updates
from zonedeck.queries.registry import ORACLES


def made(items, body, ports=None, more=""):
    """A finished run of one program, with its library."""
    found = machine.programs(f"{more}DATA DIVISION.\nWORKING-STORAGE SECTION.\n{items}\nPROCEDURE DIVISION.\n{body}")
    m = machine.Machine(found[0], {p.name: p for p in found}, ports)
    m.main()
    return m


ITEMS = """01 N PIC 9(4) VALUE 0.
01 I PIC 9(4) VALUE 0.
01 S PIC S9(3) COMP-3 VALUE -5.
01 B PIC S9(4) COMP VALUE -300.
01 T PIC X(10) VALUE "hello".
01 TAB.
   05 CNT PIC 9 VALUE 3.
   05 E OCCURS 1 TO 5 TIMES DEPENDING ON CNT ASCENDING KEY IS K INDEXED BY IX.
      10 K PIC 99 VALUE 7.
      10 V PIC X(3).
01 R REDEFINES TAB.
   05 FILLER PIC X.
   05 FIRST-E PIC X(5).
01 OUT PIC X(12).
01 P PIC 99 VALUE 1.
"""


@pytest.mark.parametrize(
    ("body", "shown"),
    [
        ("M.\n PERFORM A VARYING I FROM 10 BY -3 UNTIL I < 2.\n DISPLAY N I.\n STOP RUN.\nA.\n ADD I TO N.", ["00210001"]),
        ("M.\n PERFORM A THRU B 2 TIMES.\n DISPLAY N.\n STOP RUN.\nA.\n ADD 1 TO N.\n GO TO B.\nX.\n ADD 100 TO N.\nB.\n ADD 10 TO N.", ["0022"]),
        ("M.\n DISPLAY S B.\n ADD S B GIVING B.\n DISPLAY B.", ["-005-0300", "-0305"]),
        ("M.\n MOVE 123456 TO N.\n DISPLAY N.\n MOVE T TO OUT (3:4).\n DISPLAY OUT (3:4).", ["3456", "hell"]),
        ('M.\n MOVE "ab" TO V (1).\n DISPLAY FIRST-E.\n MOVE "12xyz" TO FIRST-E.\n DISPLAY K (1) V (1).', ["07ab ", "12xyz"]),
        ("M.\n MOVE 5 TO CNT.\n MOVE 9 TO K (5).\n SET IX TO 1.\n SEARCH E AT END DISPLAY \"none\" WHEN K (IX) = 9 DISPLAY IX END-SEARCH.", ["5"]),
        ("M.\n MOVE 1 TO CNT.\n SEARCH E AT END DISPLAY \"none\" WHEN K (IX) = 9 DISPLAY IX END-SEARCH.", ["none"]),
        ('M.\n MOVE 11 TO P.\n STRING "abc" DELIMITED BY SIZE INTO OUT WITH POINTER P ON OVERFLOW DISPLAY "over" NOT ON OVERFLOW DISPLAY "fits" END-STRING.\n DISPLAY P.', ["over", "13"]),
        ('M.\n COMPUTE N = 10 / 4 ON SIZE ERROR DISPLAY "size" NOT ON SIZE ERROR DISPLAY "fits" END-COMPUTE.\n COMPUTE N ROUNDED = 10 / 4.\n DISPLAY N.', ["size", "0003"]),
        ('M.\n EVALUATE TRUE ALSO N\n WHEN S < 0 ALSO 1 DISPLAY "one"\n WHEN S < 0 ALSO 0 DISPLAY "zero"\n WHEN OTHER DISPLAY "other"\n END-EVALUATE.', ["zero"]),
        ("M.\n READY TRACE.\n PERFORM A.\n RESET TRACE.\n STOP RUN.\nA.\n CONTINUE.", []),
        ("M.\n GO TO A B DEPENDING ON N.\n DISPLAY \"fell\".\n STOP RUN.\nA.\n DISPLAY \"a\".\nB.\n DISPLAY \"b\".", ["fell"]),
        ("M.\n ALTER X TO PROCEED TO B.\nX.\n GO TO A.\nA.\n DISPLAY \"a\".\nB.\n DISPLAY \"b\".", ["b"]),
    ],
)
def test_statements(body, shown):
    assert made(ITEMS, body).display == shown


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("M.\n MOVE 4 TO I.\n MOVE 1 TO K (I).", "SUBSCRIPT"), ("M.\n MOVE 9 TO CNT.\n MOVE 1 TO K (1).", "ODO"), ("M.\n DISPLAY T (9:5).", "REFERENCE-MODIFICATION"), ("M.\n MOVE 1000 TO S.", "DECIMAL"),
        ("M.\n MOVE T TO N.", "DECIMAL"), ("M.\n DIVIDE 0 INTO N.", "DECIMAL"), ("M.\n GO TO NOWHERE.", "PROCEDURE"), ("M.\n PERFORM A UNTIL N = 1.\nA.\n CONTINUE.", "PROCEDURE"), ("M.\n SET IX TO 6.", "INDEX"),
        ("M.\n MOVE 1 TO NOTHING.", "REFERENCE"), ('M.\n CALL "NONE".', "NESTED-PROGRAM"), ("M.\n IF T = N DISPLAY T.", "UNSUPPORTED-COMPARISON"), ("M.\n ADD T TO N.", "UNSUPPORTED-OPERAND"), ("M.\n IF MAYBE DISPLAY T.", "CONDITION"),
        ("M.\n OPEN INPUT F.", "FILE"),
    ],
)
def test_faults(body, code):
    with pytest.raises(machine.SourceError) as e:
        made(ITEMS, body)
    assert e.value.code == f"CBL-RT-{code}"


def test_trace_and_missing_dynamic_program():
    m = made(ITEMS + "01 W PIC X(4) VALUE \"NONE\".\n01 ST PIC XX.\n", "M.\n READY TRACE.\n PERFORM A.\n RESET TRACE.\n CALL W.\n MOVE PROGRAM-STATUS TO ST.\n DISPLAY ST.\n STOP RUN.\nA.\n CONTINUE.")
    assert m.trace == ["A"] and m.display == ["01"]


def test_debugging_declaratives():
    body = "DECLARATIVES.\nWATCH SECTION.\n USE FOR DEBUGGING ON A.\nW.\n DISPLAY \"at \" DEBUG-NAME.\nEND DECLARATIVES.\nM.\n PERFORM A 2 TIMES.\n STOP RUN.\nA.\n DISPLAY \"here\"."
    assert made(ITEMS, body).display == ["at A", "here"] * 2
    assert made(ITEMS, body.replace("ON A.", "ON ALL PROCEDURES.")).display == ["at M", "at A", "here", "at A", "here"]


FILES = """FILE-CONTROL.
    SELECT INF ASSIGN TO "IN" FILE STATUS IS ST.
    SELECT OUTF ASSIGN TO "OUT".
DATA DIVISION.
FILE SECTION.
FD INF.
01 REC.
   05 A PIC 9(3).
   05 B PIC X(2).
FD OUTF.
01 OREC PIC X(5).
"""
STORE = "01 ST PIC XX.\n01 EOF PIC X VALUE \"N\".\n   88 DONE VALUE \"Y\".\n"
COPY_ALL = "M.\n OPEN INPUT INF OUTPUT OUTF.\n PERFORM ONE UNTIL DONE.\n CLOSE INF OUTF.\n DISPLAY ST.\n STOP RUN.\nONE.\n READ INF AT END SET DONE TO TRUE NOT AT END WRITE OREC FROM REC AFTER ADVANCING 2 LINES END-READ."


def test_files_and_status():
    out = []
    m = made(STORE, COPY_ALL, {"IN": machine.Port(["001ab", "002cd"]), "OUT": machine.Port(None, out.append)}, FILES)
    assert out == ["\n\n001ab", "\n\n002cd"] and m.display == ["00"]
    short = made(STORE, "M.\n OPEN INPUT INF.\n READ INF AT END DISPLAY \"end\" END-READ.\n DISPLAY ST.", {"IN": machine.Port(["001"])}, FILES)
    assert short.display == ["30"]
    assert made(STORE, "M.\n OPEN INPUT INF.\n DISPLAY ST.", {}, FILES).display == ["35"]
    with pytest.raises(machine.Fault, match="35"):
        made(STORE, "M.\n OPEN I-O OUTF.", {}, FILES)


def test_runs_over_rows_and_files(spark):
    rows = spark.createDataFrame([(1, Decimal(3), "x"), (2, None, None)], "id int, n decimal(4,0), t string")
    source = f"DATA DIVISION.\nWORKING-STORAGE SECTION.\n{ITEMS}\nPROCEDURE DIVISION.\nM.\n ADD 1 TO N.\n IF N > 3 MOVE 1 TO K (9)."
    got = {r.id: r for r in machine.run_rows(source, rows).collect()}
    assert got[2].N == 1 and got[2].abend is None and got[2].K == [Decimal(7)] * 3 and got[2].T == " " * 10
    assert json.loads(got[1].abend)["code"] == "CBL-RT-SUBSCRIPT" and got[1].N is None
    assert machine.run_rows(source, rows.limit(0)).count() == 0
    lines = spark.createDataFrame([("f", k, f"{k:04d}x") for k in range(2500)] + [("g", 0, "7"), ("h", 0, "007zz")], "src_file string, record_index long, rec string").repartition(5)
    out = machine.run_files(FILES + "WORKING-STORAGE SECTION.\n" + STORE + "PROCEDURE DIVISION.\n" + COPY_ALL.replace(" AFTER ADVANCING 2 LINES", "").replace("ONE.\n READ", "ONE.\n IF ST = \"30\" MOVE 5 TO NOWHERE.\n READ"), lines, "IN", "OUT")
    of = {f: [r.rec for r in out.filter(F.col("src_file") == f).filter("kind = 'record'").orderBy("n").collect()] for f in "fgh"}
    assert of == {"f": [f"{k:04d}x" for k in range(2500)], "g": [], "h": ["007zz"]}
    assert json.loads(out.filter("src_file = 'g' AND kind = 'abend'").first().rec)["code"] == "CBL-RT-REFERENCE"


def test_execute_prefers_projections(spark):
    rows = spark.createDataFrame([(Decimal(2),)], "n decimal(4,0)")
    local = "DATA DIVISION.\n01 N PIC 9(4).\nPROCEDURE DIVISION.\nM.\n ADD 1 TO N.\n"
    assert "MapInArrow" not in machine.execute(local, rows)._jdf.queryExecution().toString()
    assert machine.execute(local.replace("ADD 1 TO N.", "PERFORM A UNTIL N > 9.\n STOP RUN.\nA.\n ADD 1 TO N."), rows).first().N == 10


def test_loops_go_as_far_as_they_must():
    body = "M.\n PERFORM A UNTIL BIG > 150000.\n DISPLAY BIG.\n STOP RUN.\nA.\n ADD 1 TO BIG."
    assert made("01 BIG PIC 9(6) VALUE 0.", body).display == ["150001"]
    records, out = [f"{k % 1000:03d}xy" for k in range(120_000)], []
    m = made(STORE, COPY_ALL.replace(" AFTER ADVANCING 2 LINES", ""), {"IN": machine.Port(iter(records)), "OUT": machine.Port(None, out.append)}, FILES)
    assert out == records and m.display == ["00"]


@pytest.mark.parametrize(
    "body",
    [
        "M.\n PERFORM A UNTIL S > 0.\nA.\n ADD 1 TO N.",  # N comes round after 10,000
        "M.\n PERFORM A VARYING I FROM 1 BY 1 UNTIL S > 0.\nA.\n CONTINUE.",
        "M.\n PERFORM A UNTIL S > 0.\nA.\n PERFORM B VARYING I FROM 1 BY 1 UNTIL I > 3.\nB.\n MOVE I TO P.",
    ],
)
def test_loops_without_end(body):
    with pytest.raises(machine.Fault, match="without end"):
        made(ITEMS, body)


def test_updates_of_a_long_file():
    records, out = [f"{k:09d}{(k % 3) * 15_000_000:011d}" for k in range(110_000)], []
    found = machine.programs(UPDATES)
    m = machine.Machine(found[0], {}, {"ORDERS": machine.Port(iter(records), out.append)})
    m.main()
    m._settled(m.ports["ORDERS"])
    assert m.display == ["1100"] and out == ["0" * 9 + r[9:] if k % 3 == 2 else r for k, r in enumerate(records) if k % 3]


def test_updates_in_the_order_of_the_keys(spark, tmp_path):
    """Keys longer than the record's fields, below zero or missing, and amounts below zero, give the rows of the SQL."""
    import duckdb

    keys = [7, 2_000_000_001, 1_000_000_002, 30, 300, 1_000_000_011, None, -5, 3_000_000_000]
    amounts = [25_000.01, 300_000.5, -40_000.25, 19_999.99, 20_000.0, -0.03, None, 200_000.01, 2e9]
    orders = [(10**13 - k * 7 if k % 5 else k, keys[k % 9], amounts[k % 7 + k % 3], "HIGH" if k % 4 else None) for k in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT src_file, kind, n, rec FROM ({ORACLES['program_updates']})").fetchall()
    got = [tuple(r) for r in program_updates(spark, str(tmp_path)).select("src_file", "kind", "n", "rec").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[3] is None for r in want)


def test_equal_rows_run_once(spark):
    """What a program does depends on its first values alone, so a task runs it once for each of them."""
    rows = spark.range(20_000, numPartitions=1).selectExpr("id", "CAST(id % 7 AS DECIMAL(4,0)) AS n", "IF(id % 3 = 0, NULL, 'x') AS t", "IF(id % 2 = 0, NULL, array(CAST(1 AS DECIMAL(2,0)), CAST(id % 5 AS DECIMAL(2,0)))) AS k")
    body = "M.\n PERFORM A UNTIL N > 600.\n DISPLAY N.\n IF T = SPACES MOVE 1 TO K (9).\n STOP RUN.\nA.\n ADD 1 TO N.\n ADD 1 TO I."
    got = machine.run_rows(f"DATA DIVISION.\nWORKING-STORAGE SECTION.\n{ITEMS}\nPROCEDURE DIVISION.\n{body}", rows)
    start = time.monotonic()
    found = got.selectExpr("count(*)", "count_if(abend IS NULL AND display[0] = '0601' AND I = 601 - id % 7 AND K[1] = IF(id % 2 = 0, 7, id % 5))", "count_if(abend LIKE '%SUBSCRIPT%' AND I IS NULL)").first()
    assert tuple(found) == (20_000, 13_333, 6_667)
    assert time.monotonic() - start < 60


def test_items_given_back(spark):
    """Items that nobody asks for don't leave the task, but a run still ends in an abend if one of them can't be shown."""
    rows = spark.createDataFrame([(1, Decimal(3)), (2, Decimal(9))], "id int, cnt decimal(1,0)")
    source = f"DATA DIVISION.\nWORKING-STORAGE SECTION.\n{ITEMS}\nPROCEDURE DIVISION.\nM.\n PERFORM A UNTIL N > 5.\n STOP RUN.\nA.\n ADD 1 TO N."
    got = machine.execute(source, rows, only=("N", "P"))
    assert got.columns == ["id", "N", "P", "display", "abend"]
    a, b = got.orderBy("id").collect()
    assert (a.N, a.P, a.abend) == (6, 1, None) and b.N is None and json.loads(b.abend)["code"] == "CBL-RT-ODO"
    local = "DATA DIVISION.\n01 CNT PIC 9.\n01 N PIC 9(4).\nPROCEDURE DIVISION.\nM.\n MOVE CNT TO N.\n"
    assert "CNT" not in [c.upper() for c in machine.execute(local, rows, only=("N",)).columns] and machine.execute(local, rows, only=("N",)).first().N == 3
