"""Queries of codecs, moves, arithmetic and sorts that no other module's records need."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic, moves, predicates, strings, text
from ..functions.floats import HexFloat, IeeeFloat
from ..functions.packed import Packed
from ..operators import audit, decode, tables
from ..plans import schema as plans
from .records import BALANCE
from .registry import BALANCE_SQL, PRICE_SQL, TOTAL_SQL, cents, dec, query, table


@query("""SELECT CAST(i AS INTEGER) AS digits, CAST(i // 2 + 1 AS INTEGER) AS byte_len, ten - 1 AS largest, 1 - ten AS least, CAST(0 AS BIGINT) AS least_unsigned
  FROM (SELECT i, CAST('1' || repeat('0', CAST(i AS INTEGER)) AS BIGINT) AS ten FROM range(1, 19) t(i))""")
def packed_shapes(spark, d):
    """Sizes and limits of every packed shape."""
    rows = [(k, Packed(k).byte_len, Packed(k).max_unscaled, Packed(k).min_unscaled, Packed(k, 0, False).min_unscaled) for k in range(1, 19)]
    return spark.createDataFrame(rows, "digits int, byte_len int, largest long, least long, least_unsigned long")


@query(f"SELECT c_custkey, lpad(CAST(abs({BALANCE_SQL}) AS VARCHAR), 9, '0') || CASE WHEN {BALANCE_SQL} < 0 THEN 'D' ELSE 'C' END AS nibbles, CASE WHEN {BALANCE_SQL} < 0 THEN '0xD' ELSE '0xC' END AS sign FROM customer")
def packed_nibbles(spark, d):
    """The nibbles of each field, one by one."""
    rows = table(spark, d, "customer").select("c_custkey", BALANCE.encode(dec("c_acctbal"))["bytes"].alias("b"))
    return rows.select("c_custkey", F.array_join(F.filter(BALANCE.nibbles(F.col("b")), lambda x: x != ""), "").alias("nibbles"), BALANCE.decode(F.col("b"))["sign_nibble"].alias("sign"))


@query("""SELECT s_suppkey, CASE WHEN k IN (12, 15) THEN n WHEN k = 13 THEN -n END AS v, CASE WHEN k < 12 OR k = 14 THEN 'E_SIGN' END AS code, CASE WHEN k IN (12, 15) THEN n END AS plain
  FROM (SELECT s_suppkey, s_suppkey % 16 AS k, s_suppkey % 1000 AS n FROM supplier)""")
def packed_program_mode(spark, d):
    """The program engine's signs, C, D and F; unsigned fields take no D."""
    signed, plain = Packed(3, 0, True, "program"), Packed(3, 0, False, "program")
    b = F.unhex(F.concat(F.lpad(F.pmod("s_suppkey", F.lit(1000)).cast("string"), 3, "0"), F.hex(F.pmod("s_suppkey", F.lit(16)))))
    rows = table(spark, d, "supplier").select("s_suppkey", signed.decode(b).alias("x"), plain.decode(b).alias("y"))
    return rows.select("s_suppkey", F.col("x.value").cast("bigint").alias("v"), F.col("x.error_code").alias("code"), F.col("y.value").cast("bigint").alias("plain"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS wide, CAST(l_quantity AS DOUBLE) AS narrow, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 1.5 END::DOUBLE AS odd FROM lineitem")
def ieee_float(spark, d):
    """IEEE numbers of both sizes there and back; non-finite ones are no values."""
    f, g = IeeeFloat(8), IeeeFloat(4)
    odd = F.when(F.pmod("l_linenumber", F.lit(3)) == 0, F.unhex(F.lit("7FF0000000000000"))).otherwise(F.unhex(F.lit("3FF8000000000000")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f.encode(F.col("l_extendedprice")).alias("a"), g.encode(F.col("l_quantity")).alias("b"), odd.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", f.decode(F.col("a")).alias("wide"), g.decode(F.col("b")).alias("narrow"), f.decode(F.col("c")).alias("odd"))


@query(f"SELECT l_orderkey, l_linenumber, {PRICE_SQL} AS cents FROM lineitem")
def ibm_float_fractions(spark, d):
    """Prices in 56-bit base-16 fractions, exact to the cent again."""
    f = HexFloat(8)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f.encode(-F.col("l_extendedprice")).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.round(-f.decode(F.col("b"))["value"] * 100).cast("bigint").alias("cents"))


@query(f"""SELECT o_orderkey, {TOTAL_SQL} + 100 AS added, {TOTAL_SQL} - 5000 AS subtracted, {TOTAL_SQL} * 3 AS multiplied, CAST({TOTAL_SQL} * 10 AS BIGINT) AS divided FROM orders""")
def arithmetic_verbs(spark, d):
    """ADD, SUBTRACT, MULTIPLY and DIVIDE into targets that hold the results."""
    t, number = dec("o_totalprice"), lambda x: F.lit(x).cast("decimal(9,2)")
    got = {"added": ("+", number("1"), 2), "subtracted": ("-", number("50"), 2), "multiplied": ("*", number("3"), 2), "divided": ("/", number("0.1"), 2)}
    return table(spark, d, "orders").select("o_orderkey", *[cents(arithmetic.strict(op, t, x, 15, scale)).alias(name) for name, (op, x, scale) in got.items()])


@query("SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS BIGINT) AS tally, replace(p_name, 'a', '#') AS changed FROM part")
def examine(spark, d):
    """EXAMINE TALLYING ALL REPLACING BY."""
    got = strings.examine(F.col("p_name"), "a", "#")
    return table(spark, d, "part").select("p_partkey", got["tally"].cast("bigint").alias("tally"), got["text"].alias("changed"))


@query("SELECT o_orderkey, 'F' AS one, 10 AS least, o_totalprice BETWEEN 10 AND 99999 AS holds FROM orders")
def set_condition(spark, d):
    """SET ... TO TRUE gives a condition's first value."""
    return table(spark, d, "orders").select(
        "o_orderkey", F.lit(predicates.first_value(["F", "O"])).alias("one"), F.lit(predicates.first_value((), [(10, 99999)])).alias("least"),
        predicates.condition_name(F.col("o_totalprice"), ranges=[(10, 99999)]).alias("holds"),
    )


@query(f"""SELECT c_custkey, rpad(left(c_name || c_mktsegment, 30), 30, ' ') AS moved, '    ' AS spaces, '0000' AS zeros, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '/' || c_mktsegment AS line,
  CASE WHEN {BALANCE_SQL} < 0 THEN '-' ELSE '' END || lpad(CAST(abs({BALANCE_SQL}) AS VARCHAR), 9, '0') AS signed_, {BALANCE_SQL} AS again FROM customer""")
def group_moves(spark, d):
    """Group bytes, a group move, figuratives, DISPLAY lines and signs."""
    name, segment = F.encode("c_name", "US-ASCII"), F.encode("c_mktsegment", "US-ASCII")
    shown = moves.signed_display(cents(dec("c_acctbal")), 10)
    return table(spark, d, "customer").select(
        "c_custkey", F.decode(moves.move_group(moves.group_bytes(name, segment), 30), "US-ASCII").alias("moved"), moves.move_figurative("SPACE", 4).alias("spaces"), moves.move_figurative("ZERO", 4).alias("zeros"),
        moves.display_line(moves.move_display(F.col("c_custkey"), 6), F.lit("/"), F.col("c_mktsegment")).alias("line"), shown.alias("signed_"), moves.read_signed_display(shown).cast("bigint").alias("again"),
    )


@query("""SELECT n_nationkey, CAST(n_regionkey + 1 AS INTEGER) AS n,
  CAST(CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 6 + 9 * (n_regionkey - 2) END AS BIGINT) AS x FROM nation""")
def odo_resize(spark, d):
    """A table of three cut or grown with its template to a new count."""
    t = moves.resize_table(F.array(F.lit(1), F.lit(2), F.lit(3)), (F.col("n_regionkey") + 1).cast("int"), F.lit(9))
    return table(spark, d, "nation").select("n_nationkey", F.size(t).alias("n"), F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("x"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END, p_partkey) AS INTEGER) AS place FROM part")
def sort_display_key(spark, d):
    """Numeric DISPLAY keys; a blank one is zero."""
    from pyspark.sql import Window

    shown = F.when(F.pmod("p_partkey", F.lit(7)) == 0, "  ").otherwise(F.lpad(F.col("p_size").cast("string"), 4, " "))
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.orderBy(tables.display_key(shown), "p_partkey")).alias("place"))


@query("SELECT k, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place FROM (SELECT c_custkey * 2 AS k FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)")
def merge_inputs(spark, d):
    """Two sorted inputs as one."""
    from pyspark.sql import Window

    merged = tables.merge_records(table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k")), table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("k")), keys=["k"])
    return merged.select("k", F.row_number().over(Window.orderBy("k")).alias("place"))


@query("""SELECT 'N' AS field, count(*) AS fields_seen, count(*) FILTER (c_custkey % 6 IN (0, 1, 4)) AS non_preferred, count(*) FILTER (c_custkey % 6 IN (1, 3) AND c_custkey % 50 = 0) AS negative_zero FROM customer""")
def sign_profile(spark, d):
    """Non-preferred signs and negative zeros of fields that take any sign."""
    plan = plans.load({"version": 1, "record_length": 2, "input_encoding": "binary", "on_error": "emit-error-row", "fields": [{"name": "N", "offset": 0, "total_digits": 3, "scale": 0, "signed": True, "sign_mode": "nopfd", "mode": "lossless"}]})
    rec = F.unhex(F.concat(F.lpad(F.pmod("c_custkey", F.lit(50)).cast("string"), 3, "0"), F.char(65 + F.pmod("c_custkey", F.lit(6)))))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("record_index"), rec.alias("rec"))
    got = audit.field_profiles(decode.decode_long(rows, plan))
    return got.select("field", "fields_seen", F.col("non_preferred_sign_count").alias("non_preferred"), F.col("negative_zero_count").alias("negative_zero"))


@query("SELECT c_custkey, c_name AS again, CAST(2 * length(c_name) AS INTEGER) AS n FROM customer")
def national_text(spark, d):
    """Texts of two bytes a letter."""
    b = F.encode("c_name", "UTF-16BE")
    return table(spark, d, "customer").select("c_custkey", text.national_text(b).alias("again"), F.octet_length(b).alias("n"))
