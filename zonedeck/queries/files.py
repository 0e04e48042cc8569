"""Queries that write files into the shared folder and read them with the record readers.

Spark writes text; binary parts are written by the tasks that hold their range of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import Packed
from ..operators import audit, decode, tables
from ..plans import schema as plans
from ..sources import records as sources
from ..sources import shared, sinks
from .records import BALANCE, ORDER_PLAN, order_records
from .registry import BALANCE_SQL, PRICE_SQL, TOTAL_SQL, cents, dec, field, query, table

ORDER_LENGTH = ORDER_PLAN.record_length
#: Orders as fields, numbered by key from 0.
ORDERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)"
CUSTOMERS = "(SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)"
FIELDS_SQL = f"""
SELECT i AS record_index, 'KEY' AS field, 0 AS "offset", CAST(o_orderkey AS VARCHAR) AS value, NULL AS error_code FROM {ORDERED} {{0}}
UNION ALL SELECT i, 'TOTAL', 4, CAST(CAST(o_totalprice AS DECIMAL(11,2)) AS VARCHAR), NULL FROM {ORDERED} {{0}}
UNION ALL SELECT i, 'STATUS', 10, o_orderstatus, NULL FROM {ORDERED} {{0}}
UNION ALL SELECT i, 'PRIORITY', 11, rpad(left(o_orderpriority, 7), 7, ' '), NULL FROM {ORDERED} {{0}}"""


def order_files(spark: SparkSession, d: str) -> DataFrame:
    """The orders' records from binary parts, with three bytes after the last whole record."""
    path = shared.scratch(spark, "orders")
    sinks.write_fixed_width(order_records(spark, d), path)
    files, folder = shared.opened(path)
    with files.open_output_stream(f"{folder}/part-99999.bin") as f:
        f.write(b"end")
    return sources.in_file_order(sources.fixed_width(spark, path, ORDER_LENGTH), spark, path, ORDER_LENGTH)


def one_text_file(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """lines (i, line) as one text file: the order of a file's lines is what gives records their numbers."""
    path = shared.scratch(spark, name)
    lines.repartition(1).sortWithinPartitions("i").select("line").write.text(path)
    return path


@query(FIELDS_SQL.format("") + " UNION ALL SELECT count(*), '<record>', 3, NULL, 'E_RECORD_LENGTH' FROM orders")
def fixed_scan_long(spark, d):
    """Binary files to the long relation; the partial tail is one bad record."""
    rows = decode.decode_long(order_files(spark, d), ORDER_PLAN, verify=True)
    return rows.select("record_index", "field", "offset", "value", "error_code")


@query(f"SELECT i AS record_index, {TOTAL_SQL} AS cents, o_orderstatus AS status FROM {ORDERED} UNION ALL SELECT count(*), NULL, NULL FROM orders")
def fixed_scan_wide(spark, d):
    """Typed columns of binary files; only those that are asked for are decoded."""
    wide = decode.decode_wide(order_files(spark, d), ORDER_PLAN)
    return wide.select("record_index", cents(F.col("TOTAL")).alias("cents"), F.col("STATUS").alias("status"))


@query(FIELDS_SQL.format("WHERE o_orderkey % 11 <> 0") + f" UNION ALL SELECT i, '<record>', NULL, NULL, 'E_HEX' FROM {ORDERED} WHERE o_orderkey % 11 = 0")
def hex_scan(spark, d):
    """Hex lines with prefix and separators; blank lines have no number, bad ones are bad records."""
    key, blank = F.col("record_index"), F.lit("\n \n")
    text = F.concat(F.lit("0x"), F.regexp_replace(F.hex("rec"), "(..)(?=.)", "$1 "), F.when(F.pmod(key, F.lit(11)) == 0, "Z").otherwise(""), F.when(F.pmod(key, F.lit(5)) == 0, blank).otherwise(""))
    got = sources.hex_lines(spark, one_text_file(spark, order_records(spark, d).select(key.alias("i"), text.alias("line")), "hex"))
    rows = decode.decode_long(got.filter("hex_error IS NULL"), ORDER_PLAN).select("record_index", "field", "offset", "value", "error_code")
    none = F.lit(None)
    return rows.union(got.filter("hex_error IS NOT NULL").select("record_index", F.lit("<record>"), none.cast("int"), none.cast("string"), "hex_error"))


def cell_plan(encoding: str) -> plans.Plan:
    spec = {"scale": 0, "signed": True, "sign_mode": "pfd", "mode": "lossless"}
    return plans.load({
        "version": 1, "input_encoding": encoding, "on_error": "emit-error-row",
        "fields": [spec | {"name": "amount", "total_digits": 9, "scale": 2}, spec | {"name": "rest", "total_digits": 3, "required": False}],
    })


@query(f"""SELECT i AS record_index, CASE WHEN c_custkey % 5 = 4 THEN '<record>' ELSE 'amount' END AS field,
  CASE c_custkey % 5 WHEN 1 THEN 'E_JSON_TYPE' WHEN 2 THEN 'E_REQUIRED' WHEN 3 THEN 'E_HEX' WHEN 4 THEN 'E_JSON' END AS error_code,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(CAST(c_acctbal AS DECIMAL(9,2)) AS VARCHAR) END AS value FROM {CUSTOMERS}""")
def jsonl_scan(spark, d):
    """JSON lines of hex cells, right, of a wrong type, without the field, with bad hex, no object."""
    h = F.hex(BALANCE.encode(dec("c_acctbal"))["bytes"])
    which = F.pmod("c_custkey", F.lit(5))
    line = F.when(which == 0, F.concat(F.lit('{"amount":"'), h, F.lit('"}'))).when(which == 1, '{"amount":12}').when(which == 2, "{}").when(which == 3, '{"amount":"0AF"}').otherwise("[1]")
    path = one_text_file(spark, table(spark, d, "customer").select(F.col("c_custkey").alias("i"), line.alias("line")), "jsonl")
    return sources.cell_rows(sources.jsonl_cells(spark, path), cell_plan("jsonl")).select("record_index", "field", "error_code", "value")


@query(f"""SELECT i AS record_index, 'amount' AS field, NULL AS error_code, CAST(CAST(c_acctbal AS DECIMAL(9,2)) AS VARCHAR) AS value FROM {CUSTOMERS} WHERE c_custkey % 7 <> 3
  UNION ALL SELECT i, 'rest', NULL, CAST(c_custkey % 1000 AS VARCHAR) FROM {CUSTOMERS} WHERE c_custkey % 7 <> 3
  UNION ALL SELECT i, '<record>', 'E_CSV', NULL FROM {CUSTOMERS} WHERE c_custkey % 7 = 3""")
def csv_scan(spark, d):
    """Hex cells under a header; lines with a wrong number of cells are bad records."""
    c = table(spark, d, "customer")
    amount, rest = F.hex(BALANCE.encode(dec("c_acctbal"))["bytes"]), F.hex(Packed(3).encode(F.pmod("c_custkey", F.lit(1000)))["bytes"])
    line = F.concat_ws(",", amount, F.when(F.pmod("c_custkey", F.lit(7)) != 3, rest))
    lines = c.select(F.col("c_custkey").alias("i"), line.alias("line")).union(spark.createDataFrame([(-1, "amount,rest")], "i long, line string"))
    rows = sources.cell_rows(sources.csv_cells(spark, one_text_file(spark, lines, "csv"), ["amount", "rest"]), cell_plan("csv"))
    return rows.select("record_index", "field", "error_code", "value")


ODO_PLAN = plans.load(
    {
        "version": 2, "layout_mode": "sequential", "on_error": "emit-error-row",
        "layout": [
            field("KEY", field_type="binary", total_digits=9, signed=False),
            field("COUNT", field_type="packed-decimal", total_digits=3, signed=False),
            {"kind": "occurs", "name": "LINES", "counter_field": "COUNT", "min_occurs": 0, "max_occurs": 200, "element_layout": [
                field("QTY", field_type="binary", total_digits=4, signed=False), field("PRICE", field_type="packed-decimal", total_digits=11, scale=2, signed=True)]},
        ],
    }
)


def odo_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as variable-length records, from binary parts that end in a record cut short."""
    key, count, lines = ODO_PLAN.items[0], ODO_PLAN.items[1], ODO_PLAN.items[2]
    qty, price = lines.items
    element = F.concat(qty.codec.encode(F.col("l_quantity").cast("decimal(9,0)")), price.codec.encode(dec("l_extendedprice")))
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.hex(element).alias("e")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "e"))).alias("l"))
    o = table(spark, d, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    some = F.unhex(F.coalesce(F.array_join(F.col("l.e"), ""), F.lit("")))
    n = F.coalesce(F.size("l"), F.lit(0))
    rec = o.select(F.col("o_orderkey").alias("record_index"), F.concat(key.codec.encode(F.col("o_orderkey")), count.codec.encode(F.when(n > 0, n).otherwise(0)), some).alias("rec"))
    path = shared.scratch(spark, "odo")
    sinks.write_fixed_width(rec, path)
    files, folder = shared.opened(path)
    with files.open_output_stream(f"{folder}/part-99999.bin") as f:
        f.write(bytes.fromhex("00000001002F0005"))
    return sources.odo_records(spark.read.format("binaryFile").load(path), ODO_PLAN)


@query(f"""SELECT o_orderkey AS k, count(l_orderkey) AS n, coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), 0) AS qty, coalesce(CAST(sum({PRICE_SQL}) AS BIGINT), 0) AS cents
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def odo_scan(spark, d):
    """Orders with their lines as variable-length records, those without lines too; a row an element, summed by record."""
    rows = decode.decode_elements(odo_files(spark, d).filter("frame_error IS NULL"), ODO_PLAN, "LINES")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.groupBy(F.col("KEY").cast("bigint").alias("k")).agg(F.count("idx").alias("n"), total(F.col("QTY")).alias("qty"), total(cents(F.col("PRICE"))).alias("cents"))


@query(f"""SELECT 'KEY' AS field, NULL AS error_code, count(*) AS n, CAST(sum(o_orderkey) * 100 AS BIGINT) AS cents FROM orders
  UNION ALL SELECT 'COUNT', NULL, count(*), (SELECT count(*) * 100 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) FROM orders
  UNION ALL SELECT 'LINES[#].QTY', NULL, count(*), CAST(sum(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'LINES[#].PRICE', NULL, count(*), CAST(sum({PRICE_SQL}) AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT '<record>', 'E_RECORD_LENGTH', 1, NULL""")
def odo_long(spark, d):
    """The long relation of variable-length records, by field; the record cut short is a bad one."""
    rows = decode.decode_long(odo_files(spark, d), ODO_PLAN, verify=True)
    shown = F.regexp_replace("field", r"\[\d+\]", "[#]").alias("field")
    return rows.groupBy(shown, "error_code").agg(F.count("*").alias("n"), cents(F.sum(F.col("value").cast("decimal(20,2)"))).alias("cents"))


@query(f"SELECT i AS record_index, rpad(left(c_name, 12), 12, ' ') AS name FROM {CUSTOMERS}")
def tape_scan(spark, d):
    """Blocks of a tape image, cut to the record length."""
    path = shared.scratch(spark, "tape")
    sinks.write_tape(table(spark, d, "customer").select(F.col("c_custkey").alias("record_index"), F.encode("c_name", "US-ASCII").alias("rec")), path)
    got = sources.tape_records(spark.read.format("binaryFile").load(path), 12)
    return got.select("record_index", F.decode("rec", "US-ASCII").alias("name"))


@query("""SELECT o_custkey, o_orderkey, CAST(CASE WHEN i < 3 THEN 1 ELSE 2 + (i - 3) // 4 END AS INTEGER) AS page, CAST(CASE WHEN i < 3 THEN 3 * (i + 1) ELSE 1 + 3 * ((i - 3) % 4) END AS INTEGER) AS line
  FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)""")
def write_advancing(spark, d):
    """K5: three lines a record and ten a page, a file for each customer."""
    return tables.advance(table(spark, d, "orders").select("o_custkey", "o_orderkey"), F.lit(3), 10, "o_orderkey", ["o_custkey"])


@query("SELECT form, 4 * (SELECT count(*) FROM orders) AS n, 4 * (SELECT count(*) FROM orders) - (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS valid FROM (VALUES ('csv'), ('jsonl'), ('parquet')) t(form)")
def row_sinks(spark, d):
    """K1: the long relation in each form, read again."""
    rows = decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN)
    out = None
    for form, read in (("csv", lambda p: spark.read.csv(p, header=True)), ("jsonl", spark.read.json), ("parquet", spark.read.parquet)):
        path = shared.scratch(spark, f"rows-{form}")
        sinks.write_rows(rows, path, form)
        one = read(path).agg(F.count("*").alias("n"), F.count_if(F.col("valid").cast("boolean")).alias("valid")).select(F.lit(form).alias("form"), "n", "valid")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT count(*) AS records_seen, 1 AS distinct_error_codes, 4 AS distinct_fields, FALSE AS field_verified, FALSE AS record_verified, 18 AS covered, TRUE AS full_, 0 AS negative_zero_count, 0 AS non_preferred_sign_count FROM orders""")
def audit_report(spark, d):
    """The report over spoilt records, through its CSV line and its dictionary."""
    got = audit.report(order_records(spark, d, spoil=True), ORDER_PLAN)
    names, values = (line.split(",") for line in sinks.audit_csv(got).splitlines())
    line = dict(zip(names, values))
    cover = got["record_coverage"]
    row = (
        got["records_seen"], int(line["distinct_error_codes"]), int(line["distinct_fields"]), got["field_byte_for_byte_verified"], got["record_byte_for_byte_verified"],
        cover["covered"], cover["full"], got["negative_zero_count"], got["non_preferred_sign_count"],
    )
    return spark.createDataFrame([row], "records_seen long, distinct_error_codes int, distinct_fields int, field_verified boolean, record_verified boolean, covered int, full_ boolean, negative_zero_count int, non_preferred_sign_count int")


@query("SELECT TRUE AS field_verified, TRUE AS record_verified, 'passed' AS status FROM range(1)")
def verify_verdicts(spark, d):
    """Whole records that come back byte for byte, under a layout that covers each byte once."""
    got = audit.report(order_records(spark, d), ORDER_PLAN)
    return spark.createDataFrame([(got["field_byte_for_byte_verified"], got["record_byte_for_byte_verified"], got["status"])], "field_verified boolean, record_verified boolean, status string")


@query("SELECT upper(sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10))) AS sha256 FROM nation")
def file_hash(spark, d):
    """The hash of a whole file."""
    path = one_text_file(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("line")), "hash")
    return audit.file_hashes(spark, path).filter(F.col("path").endswith(".txt")).select("sha256")


@query("SELECT 'E_SIGN' AS code, 'invalid sign' AS message FROM range(1) WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 7 = 0)")
def on_error_fail(spark, d):
    """the first bad row in record order stops the run."""
    try:
        decode.stop_at_error(decode.decode_long(order_records(spark, d, spoil=True), ORDER_PLAN, on_error="fail"))
    except decode.DataError as e:
        return spark.createDataFrame([(e.code, str(e).split(": ", 1)[1])], "code string, message string")
    return spark.createDataFrame([], "code string, message string")
