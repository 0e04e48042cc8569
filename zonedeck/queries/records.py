"""One query an operator group, each over whole tables, with the SQL that gives the same rows.

The tables hold ordinary columns, so a query encodes them as host bytes, runs the
operator on those, and the SQL works on the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arithmetic, moves, predicates, strings, text
from ..functions.binary import Binary
from ..functions.floats import HexFloat
from ..functions.packed import Packed, is_negative_zero
from ..functions.zoned import Zoned
from ..operators import audit, decode, tables
from ..plans import schema as plans
from .registry import BALANCE_SQL, PRICE_SQL, TOTAL_SQL, cents, dec, query, table
from .registry import field as _field

PRICE, BALANCE = Packed(13, 2), Packed(9, 2)


@query(f"SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * {PRICE_SQL}) AS BIGINT) AS cents FROM lineitem GROUP BY l_returnflag")
def packed_sum_by_flag(spark, d):
    """Prices as packed fields, those of returns with sign D; decoded and summed by flag."""
    price = dec("l_extendedprice")
    signed = F.when(F.col("l_returnflag") == "R", -price).otherwise(price)
    rows = table(spark, d, "lineitem").select("l_returnflag", PRICE.encode(signed)["bytes"].alias("b"))
    rows = rows.select("l_returnflag", PRICE.decode(F.col("b"))["value"].alias("v"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), cents(F.sum("v")).alias("cents"))


@query(f"SELECT l_orderkey, l_linenumber, {PRICE_SQL} AS cents FROM lineitem")
def packed_roundtrip(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", PRICE.encode(dec("l_extendedprice"))["bytes"].alias("b"))
    return rows.select("l_orderkey", "l_linenumber", cents(PRICE.decode(F.col("b"))["value"]).alias("cents"))


@query("""SELECT c_custkey, chr(65 + CAST(c_custkey % 6 AS INTEGER)) AS nibble,
  CASE WHEN c_custkey % 6 IN (1, 3) THEN -1 ELSE 1 END * (c_custkey % 1000) AS v,
  CASE WHEN c_custkey % 6 IN (1, 3) THEN 'negative' ELSE 'positive' END AS sign_class FROM customer""")
def packed_nopfd_signs(spark, d):
    """Every sign nibble A to F in turn."""
    shape = Packed(3, 0, True, "nopfd")
    nibble = F.char(65 + F.pmod("c_custkey", F.lit(6)))
    b = F.unhex(F.concat(F.lpad(F.pmod("c_custkey", F.lit(1000)).cast("string"), 3, "0"), nibble))
    rows = table(spark, d, "customer").select("c_custkey", nibble.alias("nibble"), shape.decode(b).alias("x"))
    return rows.select("c_custkey", "nibble", F.col("x.value").cast("bigint").alias("v"), F.col("x.sign_class").alias("sign_class"))


@query("SELECT count(*) AS n, count(*) AS same FROM customer")
def packed_lossless_identity(spark, d):
    """Bytes of any sign come back as they were."""
    shape = Packed(3, 0, True, "nopfd")
    b = F.unhex(F.concat(F.lpad(F.pmod("c_custkey", F.lit(1000)).cast("string"), 3, "0"), F.char(65 + F.pmod("c_custkey", F.lit(6)))))
    rows = table(spark, d, "customer").select(b.alias("b")).select("b", shape.decode_lossless(F.col("b")).alias("x"))
    return rows.agg(F.count("*").alias("n"), F.count_if(shape.encode_lossless(F.col("x")) == F.col("b")).alias("same"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount = 0")
def packed_negative_zero(spark, d):
    shape = Packed(3, 2)
    b = shape.encode(dec("l_discount", "decimal(3,2)"), sign=F.when(F.col("l_discount") == 0, "D").otherwise("C"))["bytes"]
    rows = table(spark, d, "lineitem").select(b.alias("b")).select(shape.decode(F.col("b")).alias("x"))
    return rows.filter(is_negative_zero(F.col("x"))).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM customer WHERE {BALANCE_SQL} % 10 <> 0")
def packed_strict_loss(spark, d):
    rows = table(spark, d, "customer").select(Packed(9, 1).encode(dec("c_acctbal"), strict=True).alias("x"))
    return rows.filter("x.error_code = 'E_PRECISION'").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, CAST({BALANCE_SQL} // 100 AS BIGINT) AS v FROM customer".replace("// 100", "/ 100").replace("CAST(CAST(CAST", "CAST(trunc(CAST(CAST").replace("AS BIGINT) / 100", "AS BIGINT) / 100.0)"))
def packed_truncate(spark, d):
    """C4: canonical encoding cuts toward zero."""
    shape = Packed(9, 0)
    rows = table(spark, d, "customer").select("c_custkey", shape.encode(dec("c_acctbal"))["bytes"].alias("b"))
    return rows.select("c_custkey", shape.decode(F.col("b"))["value"].cast("bigint").alias("v"))


@query(f"SELECT CASE WHEN {TOTAL_SQL} > 999999 THEN 'E_OVERFLOW' ELSE 'ok' END AS code, count(*) AS n FROM orders GROUP BY 1")
def packed_overflow(spark, d):
    rows = table(spark, d, "orders").select(F.coalesce(Packed(6, 2).encode(dec("o_totalprice"))["error_code"], F.lit("ok")).alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'E_LENGTH' WHEN 2 THEN 'E_PADDING' WHEN 3 THEN 'E_DIGIT' WHEN 4 THEN 'E_SIGN' ELSE 'ok' END AS code FROM part""")
def packed_errors(spark, d):
    """A byte string spoilt in each way; the first check that fails names it."""
    which = F.pmod("p_partkey", F.lit(5))
    h = F.when(which == 1, "1234").when(which == 2, "11234C").when(which == 3, "012A4C").when(which == 4, "012342").otherwise("01234C")
    rows = table(spark, d, "part").select("p_partkey", Packed(4, 2).decode(F.unhex(h)).alias("x"))
    return rows.select("p_partkey", F.coalesce("x.error_code", F.lit("ok")).alias("code"))


@query(f"""SELECT c_custkey, CASE WHEN {BALANCE_SQL} > 0 AND chr(65 + CAST(c_custkey % 6 AS INTEGER)) IN ('B', 'D')
  OR {BALANCE_SQL} < 0 AND chr(65 + CAST(c_custkey % 6 AS INTEGER)) NOT IN ('B', 'D') THEN 'E_SIGN' ELSE 'ok' END AS code FROM customer""")
def explicit_sign(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", BALANCE.encode(dec("c_acctbal"), sign=F.char(65 + F.pmod("c_custkey", F.lit(6)))).alias("x"))
    return rows.select("c_custkey", F.coalesce("x.error_code", F.lit("ok")).alias("code"))


def _zoned(spark, d, shape):
    rows = table(spark, d, "customer").select("c_custkey", shape.encode(dec("c_acctbal"))["bytes"].alias("b"))
    return rows.select("c_custkey", cents(shape.decode(F.col("b"))["value"]).alias("cents"))


@query(f"SELECT c_custkey, {BALANCE_SQL} AS cents FROM customer")
def zoned_ebcdic_roundtrip(spark, d):
    return _zoned(spark, d, Zoned(9, 2))


@query(f"SELECT c_custkey, {BALANCE_SQL} AS cents FROM customer")
def zoned_overpunch_roundtrip(spark, d):
    return _zoned(spark, d, Zoned(9, 2, True, "ascii-overpunch"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 12 WHEN 1 THEN -12 WHEN 2 THEN 12 ELSE 10 END AS v FROM part""")
def zoned_permissive(spark, d):
    """Zone 0, and zone 4 with digit 0, are read as positive."""
    which = F.pmod("p_partkey", F.lit(4))
    h = F.when(which == 0, "F1C2").when(which == 1, "F1B2").when(which == 2, "F102").otherwise("F140")
    rows = table(spark, d, "part").select("p_partkey", Zoned(2, 0, True, "ebcdic", "permissive").decode(F.unhex(h))["value"].alias("v"))
    return rows.select("p_partkey", F.col("v").cast("bigint").alias("v"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS be, -CAST(l_quantity AS BIGINT) AS le, l_orderkey AS wide FROM lineitem")
def binary_be_le(spark, d):
    be, le, wide = Binary(2, False), Binary(4, True, "little"), Binary(8, False)
    q = F.col("l_quantity").cast("decimal(9,0)")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", be.encode(q)["bytes"].alias("a"), le.encode(-q)["bytes"].alias("b"), wide.encode(F.col("l_orderkey"))["bytes"].alias("c"))
    return rows.select("l_orderkey", "l_linenumber", *[s.decode(F.col(c))["value"].cast("bigint").alias(n) for s, c, n in ((be, "a", "be"), (le, "b", "le"), (wide, "c", "wide"))])


@query(f"SELECT c_custkey, {BALANCE_SQL} AS cents FROM customer")
def binary_scaled(spark, d):
    shape = Binary(4, True, "big", 2)
    rows = table(spark, d, "customer").select("c_custkey", shape.encode(dec("c_acctbal"))["bytes"].alias("b"))
    return rows.select("c_custkey", cents(shape.decode(F.col("b"))["value"]).alias("cents"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS short, -CAST(l_quantity AS BIGINT) AS long FROM lineitem")
def ibm_float(spark, d):
    """Quantities are exact in base 16."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", HexFloat(4).encode(F.col("l_quantity")).alias("a"), HexFloat(8, "little").encode(-F.col("l_quantity")).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", HexFloat(4).decode(F.col("a"))["value"].cast("bigint").alias("short"), HexFloat(8, "little").decode(F.col("b"))["value"].cast("bigint").alias("long"))


@query("SELECT c_custkey, rpad(c_mktsegment, 12, ' ') AS seg FROM customer")
def ebcdic_text(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", text.encode_text(F.col("c_mktsegment"), 12, "ebcdic", 37).alias("b"))
    return rows.select("c_custkey", text.decode_text(F.col("b"), "ebcdic", 37)["value"].alias("seg"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey % 3 = 0")
def ascii_reject(spark, d):
    b = F.concat(F.encode("c_name", "US-ASCII"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("41"))))
    rows = table(spark, d, "customer").select(text.decode_text(b)["error_code"].alias("code"))
    return rows.filter("code = 'E_ENCODING'").agg(F.count("*").alias("n"))


ORDER_PLAN = plans.load(
    {
        "version": 2, "record_length": 18, "on_error": "emit-error-row", "verification_scope": "record",
        "layout": [
            _field("KEY", offset=0, field_type="binary", total_digits=9, signed=False),
            _field("TOTAL", offset=4, field_type="packed-decimal", total_digits=11, scale=2, signed=True),
            _field("STATUS", offset=10, field_type="alphanumeric", length=1, encoding="ebcdic", codepage="cp037"),
            _field("PRIORITY", offset=11, field_type="alphanumeric", length=7),
        ],
    }
)


def order_records(spark, d, spoil: bool = False) -> DataFrame:
    """Orders as 18-byte records numbered by key; spoil: every seventh has a bad sign."""
    o = table(spark, d, "orders")
    total = Packed(11, 2).encode(dec("o_totalprice"))["bytes"]
    if spoil:
        total = F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.unhex(F.concat(F.left(F.hex(total), F.lit(11)), F.lit("1")))).otherwise(total)
    values = {"KEY": F.col("o_orderkey"), "STATUS": F.col("o_orderstatus"), "PRIORITY": F.col("o_orderpriority")}
    parts = [f.codec.encode(values[f.path]) if f.path in values else total for f in ORDER_PLAN.fields]
    return o.select(F.col("o_orderkey").alias("record_index"), F.concat(*parts).alias("rec"))


VIEW_PLAN = plans.load(
    {
        "version": 2, "on_error": "emit-error-row",
        "layout": [
            _field("KIND", offset=0, field_type="alphanumeric", length=1),
            {"kind": "redefines", "name": "V", "offset": 1, "variants": [
                {"name": "P", "selector": {"field": "KIND", "equals": "F"}, "layout": [_field("N", offset=0, field_type="packed-decimal", total_digits=4)]},
                {"name": "T", "selector": {"field": "KIND", "equals": "O"}, "layout": [_field("S", offset=0, field_type="alphanumeric", length=3)]}]},
        ],
    }
)


@query("""SELECT field, error_code, count(*) AS n FROM (
  SELECT 'KIND' AS field, NULL AS error_code FROM orders
  UNION ALL SELECT 'V.P.N' || CASE o_orderstatus WHEN 'F' THEN ':selector-active' ELSE ':selector-inactive' END, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'E_PADDING' END FROM orders
  UNION ALL SELECT 'V.T.S' || CASE o_orderstatus WHEN 'O' THEN ':selector-active' ELSE ':selector-inactive' END, CASE WHEN o_orderstatus = 'F' THEN 'E_ENCODING' END FROM orders)
  GROUP BY field, error_code""")
def redefines_selector(spark, d):
    """Both views of the same bytes, labelled by the selector."""
    body = F.when(F.col("o_orderstatus") == "F", F.unhex(F.lit("01234F"))).otherwise(F.encode(F.lit("ABC"), "US-ASCII"))
    rec = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_index"), F.concat(F.encode("o_orderstatus", "US-ASCII"), body).alias("rec"))
    return decode.decode_long(rec, VIEW_PLAN).groupBy("field", "error_code").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('field', 'A', 0, 2), ('sync-slack', 'B', 2, 4), ('field', 'B', 4, 8), ('field', 'C', 8, 10), ('sync-slack', 'D', 10, 16), ('field', 'D', 16, 24)) t(kind, path, start, stop)")
def sync_layout(spark, d):
    """Planned offsets with slack before aligned fields."""
    plan = plans.load({"version": 2, "layout_mode": "sequential", "layout": [
        _field("A", field_type="alphanumeric", length=2), _field("B", field_type="binary", total_digits=9, sync=True),
        _field("C", field_type="alphanumeric", length=2), _field("D", field_type="ibm-float64", sync=True)]})
    return spark.createDataFrame(plan.ranges, "kind string, path string, start int, stop int")


@query("SELECT * FROM (VALUES ('gap', 3, 5), ('overlap', 7, 8), ('gap', 10, 12)) t(kind, start, stop)")
def coverage_gaps(spark, d):
    """Runs of bytes that no range, or more than one, covers."""
    ranges = spark.createDataFrame([(0, 3), (5, 8), (7, 10)], "start long, end long")
    return tables.coverage_runs(ranges, 12).select("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("stop"))


@query("""SELECT count(*) AS records_seen, count(*) FILTER (o_orderkey % 7 <> 0) AS records_valid, count(*) FILTER (o_orderkey % 7 = 0) AS records_invalid,
  4 * count(*) AS fields_seen, 4 * count(*) - count(*) FILTER (o_orderkey % 7 = 0) AS fields_valid, count(*) FILTER (o_orderkey % 7 = 0) AS fields_invalid, 'failed' AS status FROM orders""")
def audit_counters(spark, d):
    return audit.counters(decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN))


@query(f"""SELECT 'TOTAL' AS field, count(*) AS fields_seen, count(*) FILTER (o_orderkey % 7 = 0) AS fields_invalid,
  CAST(min(CASE WHEN o_orderkey % 7 <> 0 THEN {TOTAL_SQL} END) AS BIGINT) AS low, CAST(max(CASE WHEN o_orderkey % 7 <> 0 THEN {TOTAL_SQL} END) AS BIGINT) AS high FROM orders""")
def field_profile(spark, d):
    rows = audit.field_profiles(decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN, fields=["TOTAL"]))
    number = lambda c: cents(F.col(c).cast("decimal(15,2)"))
    return rows.select("field", "fields_seen", "fields_invalid", number("min_value").alias("low"), number("max_value").alias("high"))


@query("""SELECT 'TOTAL' AS field, CASE WHEN o_orderkey % 7 = 0 THEN '0x1' ELSE '0xC' END AS sign_nibble, count(*) AS n FROM orders GROUP BY 2""")
def sign_distribution(spark, d):
    rows = decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN)
    return audit.sign_distribution(rows.filter("field = 'TOTAL'"))


@query("SELECT 'TOTAL' AS field, 'E_SIGN' AS error_code, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0")
def error_distribution(spark, d):
    return audit.error_distribution(decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN))


@query("SELECT o_orderkey AS record_index, 'E_SIGN' AS error_code FROM orders WHERE o_orderkey % 7 = 0 ORDER BY o_orderkey LIMIT 25")
def failure_samples(spark, d):
    rows = decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN)
    return audit.failure_samples(rows, 25).select("record_index", "error_code")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS records FROM orders, range(4) WHERE o_orderkey % 7 <> 0")
def on_error_skip(spark, d):
    """a record with a bad field goes as a whole."""
    rows = decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN, on_error="skip-record")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("record_index").alias("records"))


@query("SELECT o_orderkey % 7 <> 0 OR f <> 'TOTAL' AS valid, count(*) AS n FROM orders, (VALUES ('KEY'), ('TOTAL'), ('STATUS'), ('PRIORITY')) t(f) GROUP BY 1")
def on_error_emit(spark, d):
    return decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN).groupBy("valid").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS record_index, count(*) AS n FROM orders, range(4) WHERE o_orderkey < 100 GROUP BY 1")
def max_records(spark, d):
    rows = decode.decode_long(order_records(spark, d), ORDER_PLAN, max_records=100)
    return rows.groupBy("record_index").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, o_totalprice BETWEEN 1000 AND 50000 OR o_totalprice BETWEEN 200000 AND 300000 AS middling FROM orders""")
def cond88(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", predicates.condition_name(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("urgent"),
        predicates.condition_name(F.col("o_totalprice"), ranges=[(1000, 50000), (200000, 300000)]).alias("middling"),
    )


@query("""SELECT p_partkey, regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]+$') AS num, regexp_matches(p_name, '^[A-Za-z ]*$') AS alpha, regexp_matches(p_name, '^[a-z ]*$') AS lower_, p_size > 25 AS pos, p_size = 25 AS zero FROM part""")
def class_and_sign_test(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", predicates.is_numeric(F.col("p_size").cast("string")).alias("num"), predicates.is_alphabetic(F.col("p_name")).alias("alpha"), predicates.is_alphabetic(F.col("p_name"), "lower").alias("lower_"),
        predicates.sign_test(F.col("p_size") - 25, "positive").alias("pos"), predicates.sign_test(F.col("p_size") - 25, "zero").alias("zero"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice BETWEEN 0 AND 100000 THEN 'small' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 250000 THEN 'large' ELSE 'other' END AS grade FROM orders""")
def evaluate_also(spark, d):
    s, t = F.col("o_orderstatus"), F.col("o_totalprice")
    grade = predicates.evaluate([s, t], [(["F", (0, 100000)], F.lit("small")), (["F", predicates.ANY], F.lit("done")), ([predicates.ANY, t > 250000], F.lit("large"))], F.lit("other"))
    return table(spark, d, "orders").select("o_orderkey", grade.alias("grade"))


@query("SELECT n_nationkey, TRUE AS same, rtrim(n_name) < rtrim(r_name) AS before FROM nation JOIN region ON n_regionkey = r_regionkey")
def relation_pad(spark, d):
    """the shorter text counts as padded."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    padded = F.concat("n_name", F.lit("   "))
    return rows.select("n_nationkey", predicates.compare(F.col("n_name"), "=", padded, text=True).alias("same"), predicates.compare(padded, "<", F.col("r_name"), text=True).alias("before"))


EBCDIC_SQL = "translate({0}, ' abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '" + "".join(chr(0x0400 + k) for k in range(63)) + "')"


@query(f"SELECT p_partkey, CAST(row_number() OVER (ORDER BY {EBCDIC_SQL.format('p_brand')}, {EBCDIC_SQL.format('p_name')}, p_partkey) AS INTEGER) AS place FROM part")
def ebcdic_collation_sort(spark, d):
    from pyspark.sql import Window

    order = Window.orderBy(predicates.ebcdic_rank(F.col("p_brand")), predicates.ebcdic_rank(F.col("p_name")), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(order).alias("place"))


@query("""SELECT o_orderkey, right(lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 38, '0'), 4) AS display, rpad(o_orderpriority, 20, ' ') AS wide, left(o_orderpriority, 3) AS narrow FROM orders""")
def move_fields(spark, d):
    """High-order digits are cut from numbers, right-hand letters from texts."""
    o, s = table(spark, d, "orders"), F.col("o_orderpriority")
    return o.select("o_orderkey", moves.move_display(F.floor("o_totalprice"), 4).alias("display"), moves.move_text(s, 20).alias("wide"), moves.move_text(s, 3).alias("narrow"))


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation, 'none' AS phone FROM customer")
def move_corresponding(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).alias("a"),
        F.struct(F.lit("").alias("name"), F.lit(0).alias("nation"), F.lit("none").alias("phone")).alias("b"),
    )
    return rows.select("c_custkey", moves.move_corresponding(rows, "a", "b").alias("b")).select("c_custkey", "b.*")


@query("SELECT c_custkey, substr(c_name, 10, 9) AS part, substr(c_name, 5) AS rest FROM customer")
def reference_modification(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", moves.reference_modified(c, 10, 9).alias("part"), moves.reference_modified(c, 5).alias("rest"))


NET = "CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(3,2)))"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN round({NET}, 2) < 50000 THEN CAST(round({NET}, 2) * 100 AS BIGINT) ELSE 0 END AS cents, round({NET}, 2) >= 50000 AS size_error FROM
  (SELECT * FROM lineitem WHERE l_extendedprice * (1 - l_discount) NOT BETWEEN 49999.9 AND 50000.1)""".replace("50000 THEN", "100000 THEN").replace(">= 50000", ">= 100000").replace("49999.9 AND 50000.1", "99999.9 AND 100000.1"))
def compute_rounded(spark, d):
    """COMPUTE ROUNDED into 9(5)V99; what doesn't fit leaves the target as it was."""
    rows = table(spark, d, "lineitem").filter(~(F.col("l_extendedprice") * (1 - F.col("l_discount"))).between(99999.9, 100000.1))
    net = dec("l_extendedprice") * (1 - dec("l_discount", "decimal(3,2)"))
    got = arithmetic.compute(net, F.lit(0).cast("decimal(7,2)"), 7, 2, rounded=True)
    return rows.select("l_orderkey", "l_linenumber", got.alias("x")).select("l_orderkey", "l_linenumber", cents(F.col("x.value")).alias("cents"), "x.size_error")


@query(f"SELECT c_custkey, {BALANCE_SQL} % 10 <> 0 AS inexact, c_custkey % 4 = 0 AS by_zero FROM customer")
def compute_size_error(spark, d):
    """Without ROUNDED lost digits are a size error; so is a zero divisor."""
    zero = F.lit(0).cast("decimal(9,2)")
    inexact = arithmetic.compute(dec("c_acctbal"), zero, 9, 1)["size_error"]
    by_zero = arithmetic.compute(F.floor(arithmetic.divide(dec("c_acctbal"), F.pmod("c_custkey", F.lit(4)).cast("decimal(9,0)"))), zero, 9, 2)["size_error"]
    return table(spark, d, "customer").select("c_custkey", inexact.alias("inexact"), by_zero.alias("by_zero"))


@query("""SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS BIGINT) AS tally, replace(p_name, 'e', 'EE') AS replaced, translate(p_name, 'abc', 'xyz') AS converted FROM part""")
def inspect(spark, d):
    p = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", strings.tally_all(p, "e").alias("tally"), strings.replace_all(p, "e", "EE").alias("replaced"), strings.convert(p, "abc", "xyz").alias("converted"))


@query("""SELECT p_partkey, rpad(split_part(p_name, ' ', 1) || '/' || p_brand, 40, ' ') AS joined, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS tally FROM part""")
def string_unstring(spark, d):
    p = F.col("p_name")
    joined, parts = strings.string_into([(p, " "), (F.lit("/"), None), (F.col("p_brand"), None)], 40), strings.unstring(p, " ", 3)
    return table(spark, d, "part").select("p_partkey", joined["text"].alias("joined"), parts["parts"][0].alias("one"), parts["parts"][1].alias("two"), parts["tally"].alias("tally"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS n, ascii(p_name) AS o, CAST(strlen(p_name) AS INTEGER) AS b FROM part")
def numval_ord_length(spark, d):
    p = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", arithmetic.numval(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).cast("bigint").alias("n"), arithmetic.ord_of(p).alias("o"), arithmetic.byte_length(p).alias("b"))


def _nations(spark, d):
    """The nation table as one array, loaded once: 25 rows."""
    n = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))).alias("t"))
    return table(spark, d, "customer").crossJoin(F.broadcast(n))


@query("SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey >= c_nationkey AND n_nationkey >= 3 ORDER BY n_nationkey LIMIT 1) AS name FROM customer")
def search_serial(spark, d):
    found = tables.search(F.col("t"), lambda e: e["k"] >= F.col("c_nationkey"), 4)
    return _nations(spark, d).select("c_custkey", found["name"].alias("name"))


@query("SELECT c_custkey, CAST(n_nationkey + 1 AS INTEGER) AS idx, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def search_all(spark, d):
    rows = _nations(spark, d).withColumn("idx", tables.search_all(F.col("t"), "k", F.col("c_nationkey")))
    return rows.select("c_custkey", "idx", moves.subscripted(F.col("t"), F.col("idx"))["name"].alias("name"))


@query(f"SELECT c_custkey, CAST(row_number() OVER (ORDER BY {BALANCE_SQL}, c_custkey) AS INTEGER) AS by_packed, CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS by_bytes FROM customer")
def sort_keys(spark, d):
    """By a packed key and by raw bytes, stable by place."""
    from pyspark.sql import Window

    rows = table(spark, d, "customer").select("c_custkey", BALANCE.encode(dec("c_acctbal"))["bytes"].alias("p"), F.encode("c_mktsegment", "US-ASCII").alias("b"))
    place = lambda key: F.row_number().over(Window.orderBy(key, "c_custkey"))
    return rows.select("c_custkey", place(BALANCE.decode(F.col("p"))["value"]).alias("by_packed"), place(F.col("b")).alias("by_bytes"))


@query(f"SELECT o_custkey, count(*) AS n, CAST(sum({TOTAL_SQL}) AS BIGINT) AS cents FROM orders GROUP BY o_custkey")
def control_break(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", dec("o_totalprice").alias("t"))
    return tables.control_break(rows, ["o_custkey"], n=F.count("*"), cents=cents(F.sum("t")))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def rewrite_delete(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return tables.delete(tables.rewrite(rows, F.col("o_orderstatus") == "F", o_orderstatus=F.lit("X")), F.col("o_orderstatus") == "P")


@query("SELECT * FROM (VALUES ('NEW', 'added'), ('STATUS', 'removed'), ('TOTAL', 'changed')) t(path, change)")
def schema_compare(spark, d):
    """One field more, one less, one of another shape."""
    other = plans.load({"version": 2, "record_length": 18, "layout": [
        _field("KEY", offset=0, field_type="binary", total_digits=9, signed=False), _field("TOTAL", offset=4, field_type="packed-decimal", total_digits=11, scale=0, signed=True),
        _field("NEW", offset=10, field_type="alphanumeric", length=1), _field("PRIORITY", offset=11, field_type="alphanumeric", length=7)]})
    return spark.createDataFrame([(r["path"], r["change"]) for r in plans.compare(ORDER_PLAN, other)], "path string, change string")


GRADING = """DATA DIVISION.
01 TOTAL PIC S9(9)V99 COMP-3.
01 STATUS-CODE PIC X.
   88 OPEN-ORDER VALUE "O" "P".
01 FEE PIC S9(7)V99 VALUE 0.
01 CAPPED PIC 9(4) VALUE 0.
01 GRADE PIC X(6) VALUE SPACES.
PROCEDURE DIVISION.
MAIN-LINE.
    COMPUTE FEE ROUNDED = TOTAL * 0.015.
    IF OPEN-ORDER AND TOTAL > 100000 THEN ADD 10 TO FEE END-IF.
    EVALUATE TRUE ALSO STATUS-CODE
      WHEN OPEN-ORDER ALSO "P" MOVE "PART" TO GRADE
      WHEN OPEN-ORDER ALSO ANY MOVE "OPEN" TO GRADE
      WHEN OTHER MOVE "CLOSED-NOW" TO GRADE
    END-EVALUATE.
    COMPUTE CAPPED ROUNDED = FEE * 2 ON SIZE ERROR MOVE 9999 TO CAPPED END-COMPUTE.
"""


@query(f"""SELECT o_orderkey, CAST(fee AS BIGINT) AS fee, CAST(CASE WHEN round(fee * 2 / 100.0) > 9999 THEN 9999 ELSE (fee * 2 + 50) // 100 END AS BIGINT) AS capped,
  CASE o_orderstatus WHEN 'P' THEN 'PART  ' WHEN 'O' THEN 'OPEN  ' ELSE 'CLOSED' END AS grade FROM (
  SELECT *, ({TOTAL_SQL} * 15 + 500) // 1000 + CASE WHEN o_orderstatus IN ('O', 'P') AND {TOTAL_SQL} > 10000000 THEN 1000 ELSE 0 END AS fee FROM orders)""")
def program_run(spark, d):
    """A row-local program over every order, as projections."""
    from ..plans import lower

    rows = table(spark, d, "orders").select("o_orderkey", dec("o_totalprice").alias("TOTAL"), F.col("o_orderstatus").alias("STATUS-CODE"))
    got = lower.run(GRADING, rows)
    return got.select("o_orderkey", cents(F.col("FEE")).alias("fee"), F.col("CAPPED").cast("bigint").alias("capped"), F.col("GRADE").alias("grade"))


@query("SELECT 'call' AS kind, o_orderpriority AS target, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'copy', o_orderstatus, count(*) FROM orders GROUP BY 2")
def dependency_edges(spark, d):
    """Edges of a program text made for each order."""
    from ..operators import programs

    text_ = F.concat(F.lit("COPY "), F.col("o_orderstatus"), F.lit('.\nCALL "'), F.col("o_orderpriority"), F.lit('".'))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), text_.alias("text"))
    return programs.dependency_edges(rows).groupBy("kind", "target").agg(F.count("*").alias("n"))
