"""Queries that run programs: once a row, or once a group of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import machine
from .registry import BALANCE_SQL, TOTAL_SQL, cents, dec, query, table

LOOPS = """DATA DIVISION.
WORKING-STORAGE SECTION.
01 N PIC 9(4).
01 I PIC 9(4) VALUE 0.
01 TOTAL PIC 9(8) VALUE 0.
01 TWICE PIC 9(8) VALUE 0.
01 POWER PIC 9(8) VALUE 1.
01 STEPS PIC 9(4) VALUE 0.
PROCEDURE DIVISION.
MAIN-LINE.
    PERFORM ADD-IT VARYING I FROM 1 BY 1 UNTIL I > N.
    PERFORM ADD-TWICE THRU ADD-AGAIN 3 TIMES.
    PERFORM DOUBLE-IT UNTIL POWER > N.
    STOP RUN.
ADD-IT.
    ADD I TO TOTAL.
ADD-TWICE.
    ADD N TO TWICE.
ADD-AGAIN.
    ADD N TO TWICE.
DOUBLE-IT.
    MULTIPLY 2 BY POWER.
    ADD 1 TO STEPS.
"""


@query("""SELECT o_orderkey, n * (n + 1) // 2 AS total, 6 * n AS twice, CAST(CASE WHEN n = 0 THEN 1 ELSE length(bin(n)) END AS BIGINT) - CASE WHEN n = 0 THEN 1 ELSE 0 END AS steps, n + 1 AS i
  FROM (SELECT o_orderkey, o_orderkey % 40 AS n FROM orders)""")
def program_loops(spark, d):
    """PERFORM VARYING, THRU, TIMES and UNTIL with limits from each row."""
    rows = table(spark, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(40)).cast("decimal(4,0)").alias("N"))
    got = machine.execute(LOOPS, rows)
    return got.select("o_orderkey", *[F.col(c).cast("bigint").alias(c.lower()) for c in ("TOTAL", "TWICE", "STEPS", "I")])


JUMPS = """DATA DIVISION.
WORKING-STORAGE SECTION.
01 KIND PIC 9.
01 PATH PIC X(20) VALUE SPACES.
01 AT-PLACE PIC 99 VALUE 1.
01 ROUNDS PIC 99 VALUE 0.
PROCEDURE DIVISION.
MAIN-LINE.
    IF KIND = 5 ALTER SWITCH TO PROCEED TO LAST-ONE.
    GO TO FIRST-ONE SECOND-ONE THIRD-ONE DEPENDING ON KIND.
    STRING "0" DELIMITED BY SIZE INTO PATH WITH POINTER AT-PLACE.
    GO TO SWITCH.
FIRST-ONE.
    STRING "1" DELIMITED BY SIZE INTO PATH WITH POINTER AT-PLACE.
SECOND-ONE.
    STRING "2" DELIMITED BY SIZE INTO PATH WITH POINTER AT-PLACE.
    ADD 1 TO ROUNDS.
    IF ROUNDS < 3 GO TO SECOND-ONE.
THIRD-ONE.
    STRING "3" DELIMITED BY SIZE INTO PATH WITH POINTER AT-PLACE.
SWITCH.
    GO TO ENDING.
LAST-ONE.
    STRING "L" DELIMITED BY SIZE INTO PATH WITH POINTER AT-PLACE.
ENDING.
    DISPLAY PATH KIND.
"""


@query("SELECT c_custkey, path, rpad(path, 20, ' ') || k AS shown FROM (SELECT c_custkey, c_custkey % 6 AS k, CASE c_custkey % 6 WHEN 1 THEN '12223' WHEN 2 THEN '2223' WHEN 3 THEN '3' WHEN 5 THEN '0L' ELSE '0' END AS path FROM customer)")
def program_jumps(spark, d):
    """GO TO, GO TO DEPENDING ON, ALTER and falling through."""
    rows = table(spark, d, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(6)).cast("decimal(1,0)").alias("KIND"))
    got = machine.execute(JUMPS, rows)
    return got.select("c_custkey", F.rtrim("PATH").alias("path"), F.get("display", F.lit(0)).alias("shown"))


TABLES = """DATA DIVISION.
WORKING-STORAGE SECTION.
01 ASKED PIC 9(5).
01 HOW-MANY PIC 99.
01 TAB.
   05 SQUARES OCCURS 1 TO 60 TIMES DEPENDING ON HOW-MANY ASCENDING KEY IS SQ INDEXED BY IX.
      10 SQ PIC 9(5).
      10 ROOT PIC 99.
01 I PIC 99.
01 FOUND-AT PIC 99 VALUE 0.
01 EXACT-ROOT PIC 99 VALUE 0.
01 LAST-SEEN PIC 99 VALUE 0.
PROCEDURE DIVISION.
MAIN-LINE.
    PERFORM FILL-ONE VARYING I FROM 1 BY 1 UNTIL I > HOW-MANY.
    SET IX TO 1.
    SEARCH SQUARES AT END MOVE 99 TO FOUND-AT WHEN SQ (IX) >= ASKED MOVE ROOT (IX) TO FOUND-AT END-SEARCH.
    SEARCH ALL SQUARES AT END MOVE 0 TO EXACT-ROOT WHEN SQ (IX) = ASKED MOVE ROOT (IX) TO EXACT-ROOT END-SEARCH.
    SET IX TO 2. SET IX UP BY 3. SET IX DOWN BY 1.
    MOVE ROOT (IX) TO LAST-SEEN.
    STOP RUN.
FILL-ONE.
    MULTIPLY I BY I GIVING SQ (I).
    MOVE I TO ROOT (I).
"""


@query("""SELECT p_partkey, CAST(CASE WHEN many * many < asked THEN 99 ELSE ceil(sqrt(asked)) END AS BIGINT) AS found_at,
  CAST(CASE WHEN sqrt(asked) = floor(sqrt(asked)) AND asked > 0 AND sqrt(asked) <= many THEN sqrt(asked) ELSE 0 END AS BIGINT) AS exact_root, CAST(4 AS BIGINT) AS last_seen
  FROM (SELECT p_partkey, p_partkey % 700 + 1 AS asked, 5 + p_partkey % 30 AS many FROM part)""")
def program_tables(spark, d):
    """A table of varying size, filled, searched serially and by key, its index set up and down."""
    rows = table(spark, d, "part").select("p_partkey", (F.pmod("p_partkey", F.lit(700)) + 1).cast("decimal(5,0)").alias("ASKED"), (F.pmod("p_partkey", F.lit(30)) + 5).cast("decimal(2,0)").alias("HOW-MANY"))
    got = machine.execute(TABLES, rows, only=("FOUND-AT", "EXACT-ROOT", "LAST-SEEN"))
    return got.select("p_partkey", *[F.col(a).cast("bigint").alias(b) for a, b in (("FOUND-AT", "found_at"), ("EXACT-ROOT", "exact_root"), ("LAST-SEEN", "last_seen"))])


TEXTS = """DATA DIVISION.
WORKING-STORAGE SECTION.
01 FULL-NAME PIC X(60).
01 ONE PIC X(20).
01 TWO PIC X(20).
01 REST PIC X(40).
01 C1 PIC 99 VALUE 0.
01 HOW-MANY PIC 99 VALUE 0.
01 JOINED PIC X(30).
01 TALLIED PIC 99 VALUE 0.
01 EXAMINED PIC 99 VALUE 0.
01 CHANGED PIC X(60).
01 PART-OF PIC X(3).
01 OVER PIC X VALUE "N".
PROCEDURE DIVISION.
MAIN-LINE.
    UNSTRING FULL-NAME DELIMITED BY ALL " " INTO ONE COUNT IN C1 TWO TALLYING IN HOW-MANY ON OVERFLOW MOVE "Y" TO OVER END-UNSTRING.
    STRING TWO DELIMITED BY SPACE "/" DELIMITED BY SIZE ONE DELIMITED BY SPACE INTO JOINED.
    INSPECT FULL-NAME TALLYING TALLIED FOR ALL "e".
    EXAMINE FULL-NAME TALLYING ALL "l".
    MOVE TALLY TO EXAMINED.
    MOVE FULL-NAME TO CHANGED.
    INSPECT CHANGED CONVERTING "abc" TO "xyz".
    MOVE FULL-NAME (2:3) TO PART-OF.
    MOVE "*" TO CHANGED (1:1).
"""


@query("""SELECT p_partkey, one, two, CAST(length(one) AS BIGINT) AS c1, two || '/' || one AS joined,
  CAST(length(p_name) - length(replace(p_name, 'e', '')) AS BIGINT) AS tallied, CAST(length(p_name) - length(replace(p_name, 'l', '')) AS BIGINT) AS examined,
  '*' || substr(translate(p_name, 'abc', 'xyz'), 2) AS changed, substr(p_name, 2, 3) AS part_of
  FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part)""")
def program_texts(spark, d):
    """STRING, UNSTRING, INSPECT, EXAMINE and parts of texts in a program."""
    got = machine.execute(TEXTS, table(spark, d, "part").select("p_partkey", F.col("p_name").alias("FULL-NAME")))
    trimmed = [F.rtrim(a).alias(b) for a, b in (("ONE", "one"), ("TWO", "two"), ("JOINED", "joined"), ("CHANGED", "changed"))]
    return got.select("p_partkey", *trimmed, F.col("PART-OF").alias("part_of"), *[F.col(a).cast("bigint").alias(a.lower()) for a in ("C1", "TALLIED", "EXAMINED")])


CALLS = """IDENTIFICATION DIVISION.
PROGRAM-ID. OUTER.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 BALANCE PIC S9(9)V99.
01 PLACE.
   05 TAX PIC S9(9)V99 VALUE 0.
   05 CALLS PIC 99 VALUE 0.
01 WHO PIC X(8) VALUE "MISSING".
01 STATE PIC XX.
PROCEDURE DIVISION.
MAIN-LINE.
    CALL "TAXES" USING BALANCE PLACE.
    CALL "TAXES" USING BALANCE PLACE.
    CALL "COUNTER" USING CALLS.
    CALL WHO.
    MOVE PROGRAM-STATUS TO STATE.
    GOBACK.
IDENTIFICATION DIVISION.
PROGRAM-ID. TAXES.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 TIMES-HERE PIC 99 VALUE 0.
LINKAGE SECTION.
01 AMOUNT PIC S9(9)V99.
01 RESULT.
   05 DUE PIC S9(9)V99.
   05 N PIC 99.
PROCEDURE DIVISION USING AMOUNT RESULT.
ONLY.
    ADD 1 TO TIMES-HERE.
    COMPUTE DUE ROUNDED = AMOUNT * 0.19.
    MOVE TIMES-HERE TO N.
    EXIT PROGRAM.
IDENTIFICATION DIVISION.
PROGRAM-ID. COUNTER IS INITIAL.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 FRESH PIC 99 VALUE 10.
LINKAGE SECTION.
01 N PIC 99.
PROCEDURE DIVISION USING N.
ONLY.
    ADD FRESH TO N.
    EXIT PROGRAM.
"""


@query(f"""SELECT c_custkey, CAST(CASE WHEN b < 0 THEN -((-b * 19 + 50) // 100) ELSE (b * 19 + 50) // 100 END AS BIGINT) AS tax, CAST(12 AS BIGINT) AS calls, '01' AS state
  FROM (SELECT c_custkey, {BALANCE_SQL} AS b FROM customer)""")
def program_calls(spark, d):
    """CALL by literal and by name with items by reference, state between calls, INITIAL, a missing program."""
    got = machine.execute(CALLS, table(spark, d, "customer").select("c_custkey", dec("c_acctbal", "decimal(11,2)").alias("BALANCE")))
    return got.select("c_custkey", cents(F.col("TAX")).alias("tax"), F.col("CALLS").cast("bigint").alias("calls"), F.col("STATE").alias("state"))


MOVES = """DATA DIVISION.
WORKING-STORAGE SECTION.
01 AMOUNT PIC S9(9)V99.
01 A.
   05 CODE-A PIC X(3) VALUE "abc".
   05 NUM-A PIC 9(4) VALUE 12.
01 B REDEFINES A.
   05 FIRST-TWO PIC XX.
   05 LAST-FIVE PIC X(5).
01 C PIC X(9).
01 SHORT-NUM PIC 9(3).
01 PACKED-NUM PIC S9(9)V99 COMP-3.
01 BIN-NUM PIC S9(9) COMP.
01 FILL PIC X(4).
01 ALL-OF PIC X(5).
01 STATUS-CODE PIC X VALUE "A".
   88 CLOSED VALUE "C".
PROCEDURE DIVISION.
MAIN-LINE.
    MOVE A TO C.
    MOVE 12345 TO SHORT-NUM.
    MOVE AMOUNT TO PACKED-NUM.
    ADD 1 TO PACKED-NUM.
    SUBTRACT 1 FROM PACKED-NUM GIVING PACKED-NUM.
    MOVE -77 TO BIN-NUM.
    MULTIPLY 2 BY BIN-NUM.
    DIVIDE 7 INTO BIN-NUM.
    MOVE HIGH-VALUES TO FILL.
    MOVE ALL "xy" TO ALL-OF.
    IF PACKED-NUM NEGATIVE SET CLOSED TO TRUE.
"""


@query(f"""SELECT c_custkey, {BALANCE_SQL} AS packed_num, CAST(-22 AS BIGINT) AS bin_num, 'abc0012  ' AS c, CAST(345 AS BIGINT) AS short_num, 'ab' AS first_two, 'c0012' AS last_five, 'xyxyx' AS all_of,
  CASE WHEN {BALANCE_SQL} < 0 THEN 'C' ELSE 'A' END AS status_code FROM customer""")
def program_moves(spark, d):
    """Groups, redefinitions, figuratives, packed and binary items, SET TRUE."""
    got = machine.run_rows(MOVES, table(spark, d, "customer").select("c_custkey", dec("c_acctbal", "decimal(11,2)").alias("AMOUNT")))
    numbers = [F.col("BIN-NUM").cast("bigint").alias("bin_num"), F.col("SHORT-NUM").cast("bigint").alias("short_num"), cents(F.col("PACKED-NUM")).alias("packed_num")]
    texts = [F.col(a).alias(a.lower().replace("-", "_")) for a in ("C", "FIRST-TWO", "LAST-FIVE", "ALL-OF", "STATUS-CODE")]
    return got.select("c_custkey", *numbers, *texts)


ABENDS = """DATA DIVISION.
WORKING-STORAGE SECTION.
01 K PIC 99.
01 TAB.
   05 E PIC 9 OCCURS 10 TIMES.
01 T PIC X(4) VALUE "12x4".
01 N PIC 9(4) VALUE 0.
PROCEDURE DIVISION.
MAIN-LINE.
    MOVE 1 TO E (K).
    IF K = 7 GO TO CONVERT-IT.
    IF K = 8 GO TO FOREVER.
    STOP RUN.
CONVERT-IT.
    MOVE T TO N.
FOREVER.
    PERFORM SPIN UNTIL K > 90.
SPIN.
    MOVE 1 TO N.
"""


@query("""SELECT s_suppkey, CASE WHEN k = 0 OR k > 10 THEN 'CBL-RT-SUBSCRIPT' WHEN k = 7 THEN 'CBL-RT-DECIMAL' END AS code, CASE WHEN k = 7 THEN 'CONVERT-IT' WHEN k = 0 OR k > 10 THEN 'MAIN-LINE' END AS paragraph
  FROM (SELECT s_suppkey, s_suppkey % 13 AS k FROM supplier) WHERE k <> 8""")
def program_abends(spark, d):
    """The report of runs that break off."""
    k = F.pmod("s_suppkey", F.lit(13))
    got = machine.run_rows(ABENDS, table(spark, d, "supplier").filter(k != 8).select("s_suppkey", k.cast("decimal(2,0)").alias("K")))
    report = lambda key: F.get_json_object("abend", f"$.{key}")
    return got.select("s_suppkey", report("code").alias("code"), report("paragraph").alias("paragraph"))


BREAKS = """ENVIRONMENT DIVISION.
INPUT-OUTPUT SECTION.
FILE-CONTROL.
    SELECT ORDERS ASSIGN TO "ORDERS" FILE STATUS IS ST.
    SELECT TOTALS ASSIGN TO "TOTALS".
DATA DIVISION.
FILE SECTION.
FD ORDERS.
01 ORDER-REC.
   05 CUST PIC 9(9).
   05 AMOUNT PIC 9(9)V99.
FD TOTALS.
01 TOTAL-REC.
   05 T-CUST PIC 9(9).
   05 T-COUNT PIC 9(4).
   05 T-AMOUNT PIC 9(11)V99.
WORKING-STORAGE SECTION.
01 ST PIC XX.
01 EOF-FLAG PIC X VALUE "N".
   88 AT-EOF VALUE "Y".
01 LAST-CUST PIC 9(9) VALUE 0.
01 N PIC 9(4) VALUE 0.
01 SUM-AMOUNT PIC 9(11)V99 VALUE 0.
PROCEDURE DIVISION.
MAIN-LINE.
    OPEN INPUT ORDERS.
    OPEN OUTPUT TOTALS.
    PERFORM READ-ONE.
    PERFORM TAKE-ONE UNTIL AT-EOF.
    IF N > 0 PERFORM WRITE-TOTAL.
    DISPLAY ST.
    CLOSE ORDERS TOTALS.
    READ ORDERS AT END DISPLAY "never" END-READ.
    DISPLAY ST.
    STOP RUN.
READ-ONE.
    READ ORDERS AT END SET AT-EOF TO TRUE END-READ.
TAKE-ONE.
    IF N > 0 AND CUST <> LAST-CUST PERFORM WRITE-TOTAL.
    MOVE CUST TO LAST-CUST.
    ADD 1 TO N.
    ADD AMOUNT TO SUM-AMOUNT.
    PERFORM READ-ONE.
WRITE-TOTAL.
    MOVE LAST-CUST TO T-CUST.
    MOVE N TO T-COUNT.
    MOVE SUM-AMOUNT TO T-AMOUNT.
    WRITE TOTAL-REC.
    MOVE 0 TO N.
    MOVE 0 TO SUM-AMOUNT.
"""


def _padded(x, n: int):
    return F.lpad(x.cast("string"), n, "0")


def order_lines(spark, d, rec: Column | None = None) -> DataFrame:
    """(src_file, record_index, rec): a file for each priority, its orders by customer. The index holds the keys as numbers, whatever their length, nulls last."""
    rec = F.concat(_padded(F.col("o_custkey"), 9), _padded(cents(dec("o_totalprice")), 11)) if rec is None else rec
    index = F.struct(*[x for k in ("o_custkey", "o_orderkey") for x in (F.col(k).isNull().alias(f"no_{k}"), F.col(k))])
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("src_file"), index.alias("record_index"), rec.alias("rec"))


@query(f"""SELECT o_orderpriority AS src_file, 'record' AS kind, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) - 1 AS n,
  lpad(CAST(o_custkey AS VARCHAR), 9, '0') || lpad(CAST(count(*) AS VARCHAR), 4, '0') || lpad(CAST(CAST(sum({TOTAL_SQL}) AS BIGINT) AS VARCHAR), 13, '0') AS rec FROM orders GROUP BY o_orderpriority, o_custkey
  UNION ALL SELECT DISTINCT o_orderpriority, 'display', 0, '10' FROM orders UNION ALL SELECT DISTINCT o_orderpriority, 'display', 1, '90' FROM orders""")
def program_files(spark, d):
    """A READ loop with a control break, WRITE, CLOSE and file status, a run a file."""
    return machine.run_files(BREAKS, order_lines(spark, d), "ORDERS", "TOTALS")


SORTS = """FILE-CONTROL.
    SELECT ORDERS ASSIGN TO "ORDERS".
    SELECT BEST ASSIGN TO "BEST".
    SELECT WORK ASSIGN TO "WORK".
DATA DIVISION.
FILE SECTION.
FD ORDERS.
01 ORDER-REC.
   05 CUST PIC 9(9).
   05 AMOUNT PIC 9(11).
FD BEST.
01 BEST-REC PIC X(20).
SD WORK.
01 WORK-REC.
   05 W-AMOUNT PIC 9(11).
   05 W-CUST PIC 9(9).
WORKING-STORAGE SECTION.
01 EOF-FLAG PIC X VALUE "N".
   88 AT-EOF VALUE "Y".
01 HELD PIC X(20).
PROCEDURE DIVISION.
MAIN-LINE.
    OPEN INPUT ORDERS OUTPUT BEST.
    SORT WORK ON DESCENDING KEY W-AMOUNT INPUT PROCEDURE IS TAKE-IN OUTPUT PROCEDURE IS GIVE-OUT THRU GIVE-END.
    CLOSE ORDERS BEST.
    STOP RUN.
TAKE-IN.
    READ ORDERS AT END SET AT-EOF TO TRUE NOT AT END
      IF AMOUNT > 10000000 MOVE AMOUNT TO W-AMOUNT MOVE CUST TO W-CUST RELEASE WORK-REC END-IF
    END-READ.
    IF NOT AT-EOF GO TO TAKE-IN.
GIVE-OUT.
    RETURN WORK INTO HELD AT END GO TO GIVE-END NOT AT END WRITE BEST-REC FROM HELD END-RETURN.
    GO TO GIVE-OUT.
GIVE-END.
    EXIT.
"""


@query(f"""SELECT o_orderpriority AS src_file, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {TOTAL_SQL} DESC, o_custkey, o_orderkey) - 1 AS n,
  lpad(CAST({TOTAL_SQL} AS VARCHAR), 11, '0') || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS rec FROM orders WHERE {TOTAL_SQL} > 10000000""")
def program_sort(spark, d):
    """SORT with INPUT and OUTPUT PROCEDURE, RELEASE and RETURN, stable."""
    return machine.run_files(SORTS, order_lines(spark, d), "ORDERS", "BEST").select("src_file", "n", "rec")


UPDATES = """FILE-CONTROL.
    SELECT ORDERS ASSIGN TO "ORDERS" FILE STATUS IS ST.
    SELECT GONE ASSIGN TO "GONE".
DATA DIVISION.
FILE SECTION.
FD ORDERS.
01 ORDER-REC.
   05 CUST PIC 9(9).
   05 AMOUNT PIC S9(11).
FD GONE.
01 GONE-REC PIC X.
WORKING-STORAGE SECTION.
01 ST PIC XX.
01 EOF-FLAG PIC X VALUE "N".
   88 AT-EOF VALUE "Y".
01 BAD PIC 9 VALUE 0.
01 ERRORS PIC 9 VALUE 0.
PROCEDURE DIVISION.
DECLARATIVES.
ON-GONE SECTION.
    USE AFTER ERROR PROCEDURE ON GONE.
COUNT-IT.
    ADD 1 TO ERRORS.
END DECLARATIVES.
MAIN-LINE.
    OPEN INPUT GONE.
    OPEN I-O ORDERS.
    DELETE ORDERS.
    IF ST = "90" MOVE 1 TO BAD.
    PERFORM ONE-ORDER UNTIL AT-EOF.
    CLOSE ORDERS.
    DISPLAY BAD ERRORS ST.
    STOP RUN.
ONE-ORDER.
    READ ORDERS AT END SET AT-EOF TO TRUE NOT AT END PERFORM CHANGE-ONE END-READ.
CHANGE-ONE.
    IF AMOUNT < 2000000 DELETE ORDERS
    ELSE IF AMOUNT > 20000000 MOVE 0 TO CUST REWRITE ORDER-REC END-IF
    END-IF.
"""


@query(f"""SELECT o_orderpriority AS src_file, 'record' AS kind, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) - 1 AS n,
  CASE WHEN {TOTAL_SQL} > 20000000 THEN '000000000' ELSE lpad(CAST(o_custkey AS VARCHAR), 9, '0') END || lpad(CAST({TOTAL_SQL} AS VARCHAR), 11, '0') AS rec FROM orders WHERE {TOTAL_SQL} >= 2000000
  UNION ALL SELECT DISTINCT o_orderpriority, 'display', 0, '1100' FROM orders""")
def program_updates(spark, d):
    """I-O with REWRITE and DELETE, status 90 without a READ, a declarative for a file that isn't there."""
    total, none = cents(dec("o_totalprice")), " " * 9
    digits = _padded(F.abs(total), 11)
    amount = F.when(total < 0, F.concat(digits.substr(1, 10), F.translate(digits.substr(11, 1), "0123456789", "}JKLMNOPQR"))).otherwise(digits)
    got = machine.run_files(UPDATES, order_lines(spark, d, F.concat(F.coalesce(_padded(F.col("o_custkey"), 9), F.lit(none)), amount)), "ORDERS", "ORDERS")
    return got.withColumn("rec", F.when(~F.col("rec").startswith(none), F.col("rec")))  # an order without a customer has spaces for it


RERUNS = """FILE-CONTROL.
    SELECT NATIONS ASSIGN TO "NATIONS".
    RERUN ON SAVED EVERY 10 RECORDS OF NATIONS.
DATA DIVISION.
FILE SECTION.
FD NATIONS.
01 NATION-REC.
   05 NUM PIC 9(4).
   05 NAME PIC X(20).
WORKING-STORAGE SECTION.
01 TOTAL PIC 9(6) VALUE 0.
01 EOF-FLAG PIC X VALUE "N".
   88 AT-EOF VALUE "Y".
PROCEDURE DIVISION.
MAIN-LINE.
    OPEN INPUT NATIONS.
    PERFORM ONE UNTIL AT-EOF.
    DISPLAY TOTAL.
    STOP RUN.
ONE.
    READ NATIONS AT END SET AT-EOF TO TRUE NOT AT END ADD NUM TO TOTAL END-READ.
"""


@query("SELECT CAST(count(*) // 10 AS BIGINT) AS checkpoints, CAST(10 AS BIGINT) AS restored_at, CAST((SELECT sum(n_nationkey) FROM (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 9)) AS BIGINT) AS total_then, 'CBL-RT-FILE' AS other_file FROM nation")
def program_checkpoints(spark, d):
    """A checkpoint at every tenth READ, before what follows it, restored into a fresh run, refused for a file with other records."""
    rows = [f"{r.n_nationkey:04d}{r.n_name:<20}" for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    source, saved = machine.programs(RERUNS)[0], []
    first = machine.Machine(source, {}, {"NATIONS": machine.Port(rows)})
    first.on_checkpoint = saved.append
    first.main()
    again = machine.Machine(source, {}, {"NATIONS": machine.Port(rows)})
    again.restore(saved[0])
    code = ""
    try:
        machine.Machine(source, {}, {"NATIONS": machine.Port(["0099" + rows[0][4:], *rows[1:]])}).restore(saved[0])
    except machine.Fault as e:
        code = e.code
    row = (len(saved), again.ports["NATIONS"].read, int(again.number("TOTAL")), code)
    return spark.createDataFrame([row], "checkpoints long, restored_at long, total_then long, other_file string")
