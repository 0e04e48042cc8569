"""Byte fixtures, laws and lookups of the record engine."""

import itertools
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from zonedeck.functions import arithmetic, moves, predicates, strings, text
from zonedeck.functions.binary import Binary
from zonedeck.functions.floats import HexFloat, IeeeFloat
from zonedeck.functions.packed import ACCEPTED, Packed, is_negative_zero
from zonedeck.functions.zoned import Zoned
from zonedeck.operators import audit, decode, tables
from zonedeck.plans import copybook, schema
from zonedeck.sources import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def raw(h):
    return F.unhex(F.lit(h))


def field(name, **k):
    return {"kind": "field", "name": name, **k}


def frame(spark, *hexes):
    return spark.createDataFrame([(i, bytearray(bytes.fromhex(h))) for i, h in enumerate(hexes)], "record_index long, rec binary")


def test_every_two_byte_packed_field(spark):
    """All 65536 contents of a 3-digit field, both signs and modes: the code or value of the rules, and the bytes again."""
    rows = spark.range(65536).select(F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("b"), F.lpad(F.hex("id"), 4, "0").alias("h"))
    for mode, signed in itertools.product(("pfd", "nopfd", "program"), (True, False)):
        shape = Packed(3, 0, signed, mode)
        got = rows.select("h", shape.decode(F.col("b")).alias("x"), "b").select("h", "x", (shape.encode_lossless(F.col("x")) == F.col("b")).alias("same"))
        for h, x, same in got.collect():
            code = "E_DIGIT" if not h[:3].isdigit() else "E_SIGN" if h[3] not in ACCEPTED[mode, signed] else None
            assert x.error_code == code
            if code is None:
                assert x.value == int(h[:3]) * (-1 if h[3] in "BD" else 1)
                assert same


@pytest.mark.parametrize(
    ("shape", "h", "value", "code"),
    [
        (Packed(4, 2), "01234C", Decimal("12.34"), None), (Packed(4, 2), "11234C", None, "E_PADDING"), (Packed(4, 2), "1234", None, "E_LENGTH"),
        (Packed(4), "414243", None, "E_PADDING"), (Packed(5, 0, True, "program"), "12345D", -12345, None), (Packed(3, 0, False, "program"), "123F", 123, None),
        (Zoned(4, 2), "F1F2F3D4", Decimal("-12.34"), None), (Zoned(4), "F1F2E3D4", None, "E_DIGIT"), (Zoned(2), "F1A2", None, "E_SIGN"),
        (Zoned(2, 0, True, "ebcdic", "non-preferred"), "F1B2", -12, None), (Zoned(2, 0, True, "ebcdic", "permissive"), "F140", 10, None),
        (Zoned(3, 0, True, "ascii-overpunch"), "31324C", -123, None), (Zoned(3, 0, False, "ascii-overpunch"), "31324C", None, "E_SIGN"),
        (Binary(4, False), "000186A0", 100000, None), (Binary(2, True, "big", 2), "04D2", Decimal("12.34"), None), (Binary(2, True, "little"), "FEFF", -2, None),
        (Binary(8, False), "FF" * 8, 2**64 - 1, None), (HexFloat(4), "42640000", 100.0, None), (HexFloat(4, "little"), "00006442", 100.0, None),
    ],
)
def test_decoding_fixtures(spark, shape, h, value, code):
    got = one(spark, shape.decode(raw(h)))
    assert (got["value"], got["error_code"]) == (value, code)


def test_encoding_fixtures(spark):
    dec = lambda x: F.lit(x).cast("decimal(20,3)")
    cases = [
        (Packed(3).encode(dec("123")), "123C", None), (Packed(3).encode(dec("-45")), "045D", None), (Packed(4, 2).encode(dec("12.345")), "01234C", None),
        (Packed(4, 2).encode(dec("12.345"), strict=True), None, "E_PRECISION"), (Packed(3).encode(dec("1234")), None, "E_OVERFLOW"), (Packed(3, 0, False).encode(dec("-1")), None, "E_SIGN"),
        (Packed(3).encode(dec("5"), sign=F.lit("F")), "005F", None), (Packed(3).encode(dec("5"), sign=F.lit("D")), None, "E_SIGN"), (Packed(3).encode(dec("0"), sign=F.lit("0xB")), "000B", None),
        (Zoned(3).encode(dec("-123")), "F1F2D3", None), (Zoned(3, 0, True, "ascii-overpunch").encode(dec("-123")), "31324C", None), (Binary(2).encode(dec("40000")), None, "E_OVERFLOW"),
    ]
    for column, h, code in cases:
        got = one(spark, F.struct(F.hex(column["bytes"]).alias("h"), column["error_code"].alias("c")))
        assert (got["h"], got["c"]) == (h, code)
    for x, n, endian, h in ((100.0, 4, "big", "42640000"), (-1.0, 4, "big", "C1100000"), (100.0, 4, "little", "00006442"), (0.0, 8, "big", "00" * 8)):
        assert one(spark, F.hex(HexFloat(n, endian).encode(F.lit(x)))) == h
    assert one(spark, HexFloat(4).encode(F.lit(1e80))) is None
    assert one(spark, IeeeFloat(4).decode(raw("3FC00000"))) == 1.5 and one(spark, IeeeFloat(8).decode(raw("7FF0000000000000"))) is None
    assert one(spark, is_negative_zero(Packed(3).decode(raw("000D"))))


def test_seeded_round_trips(spark):
    rng = random.Random(8)
    for digits, scale in ((1, 0), (5, 2), (9, 9), (18, 0), (18, 7)):
        values = [Decimal(rng.randint(-(10**digits) + 1, 10**digits - 1)).scaleb(-scale) for _ in range(60)]
        df = spark.createDataFrame([(v,) for v in values], f"v decimal({digits},{scale})")
        for shape in (Packed(digits, scale), Zoned(digits, scale), Zoned(digits, scale, True, "ascii-overpunch"), Binary(8, True, "little", scale)):
            got = df.select("v", shape.encode(F.col("v"))["bytes"].alias("b")).select("v", shape.decode(F.col("b"))["value"].alias("w"))
            assert all(r.v == r.w for r in got.collect())


def test_all_bytes_of_the_code_pages(spark):
    for page, codec in text.CODEPAGES.items():
        want = bytes(range(256)).decode(codec)
        if page == 1148:
            want = want[:0x9F] + "€" + want[0xA0:]
        b = F.lit(bytes(range(256)))
        assert one(spark, text.ebcdic_text(b, page)) == want
        assert one(spark, F.hex(text.ebcdic_bytes(text.ebcdic_text(b, page), page))) == bytes(range(256)).hex().upper()
    assert one(spark, text.decode_text(raw("41FF"))["error_code"]) == "E_ENCODING"
    assert one(spark, text.parse_hex(F.lit("0AF"))["error_code"]) == "E_HEX"
    assert one(spark, text.national_text(raw("00410042"))) == "AB"


def test_layouts(spark):
    plan = schema.load({"version": 2, "on_error": "emit-error-row", "layout": [
        field("count", offset=0, field_type="packed-decimal", total_digits=1, signed=False),
        {"kind": "occurs", "name": "items", "offset": 1, "counter_field": "count", "min_occurs": 0, "max_occurs": 2, "element_layout": [field("code", offset=0, field_type="binary", total_digits=4, signed=False)]},
        field("tail", offset=5, field_type="alphanumeric", length=1)]})
    rows = [(r.record_index, r.field, r.value, r.error_code) for r in decode.decode_long(frame(spark, "1F002AAABB5A", "3F"), plan).collect()]
    assert rows == [(0, "count", "1", None), (0, "items[0].code", "42", None), (0, "tail", "Z", None), (1, "<record>", None, "E_OCCURS_COUNT")]
    view = schema.load({"version": 2, "on_error": "emit-error-row", "layout": [
        field("t", offset=0, field_type="alphanumeric", length=1),
        {"kind": "redefines", "name": "v", "offset": 1, "variants": [
            {"name": "p", "selector": {"field": "t", "equals": "A"}, "layout": [field("n", offset=0, field_type="packed-decimal", total_digits=4)]},
            {"name": "x", "selector": {"field": "t", "equals": "B"}, "layout": [field("r", offset=0, field_type="alphanumeric", length=3)]}]}]})
    rows = [(r.field, r.value, r.error_code) for r in decode.decode_long(frame(spark, "41414243"), view).collect()]
    assert rows == [("t", "A", None), ("v.p.n:selector-active", None, "E_PADDING"), ("v.x.r:selector-inactive", "ABC", None)]


@pytest.mark.parametrize(
    "bad",
    [
        {"version": 3}, {"version": 2, "layout": []}, {"version": 2, "layout": [field("a", offset=0, field_type="zoned-decimal", total_digits=19)]},
        {"version": 2, "layout": [field("a", offset=0, field_type="packed-decimal", total_digits=3, scale=4)]}, {"version": 2, "layout": [field("a", offset=0, field_type="alphanumeric", length=0)]},
        {"version": 2, "layout_mode": "sequential", "layout": [field("c", field_type="packed-decimal", total_digits=2, scale=1), {"kind": "occurs", "name": "t", "counter_field": "c", "min_occurs": 0, "max_occurs": 2, "element_layout": []}]},
        {"version": 2, "layout_mode": "sequential", "layout": [field("c", field_type="packed-decimal", total_digits=1), {"kind": "occurs", "name": "t", "counter_field": "c", "min_occurs": 0, "max_occurs": 2, "element_layout": []}, field("z", field_type="alphanumeric", length=1)]},
        {"version": 1, "input_encoding": "binary", "fields": [{"name": "a", "offset": 0, "total_digits": 3, "signed": True}]},
    ],
)
def test_schemas_that_cannot_be_planned(bad):
    with pytest.raises(schema.SchemaError):
        schema.load(bad)


def test_schema_hash_ignores_formatting_and_copybooks():
    data = copybook.to_schema("       05 ACCOUNT-NAME PIC X(03).\n       05 BALANCE PIC S9(5)V99 COMP-3.\n       05 TXN-COUNT PIC 9(04) COMP.\n", 9)
    plan = schema.load(data)
    assert [(f.path, f.offset, f.length) for f in plan.fields] == [("ACCOUNT-NAME", 0, 3), ("BALANCE", 3, 4), ("TXN-COUNT", 7, 2)]
    assert plan.coverage()["full"]
    assert schema.load(json.dumps(data, indent=4)).semantic_hash == plan.semantic_hash
    with pytest.raises(schema.SchemaError):
        copybook.to_schema("05 A PIC X OCCURS 3 TIMES.")
    assert schema.coverage([(0, 3), (5, 8), (7, 10)], 12) == {"covered": 8, "gaps": [(3, 5), (10, 12)], "overlaps": [(7, 8)], "full": False}


def test_audit_of_skipped_records(spark):
    spec = {"name": "amount", "offset": 0, "total_digits": 4, "scale": 2, "signed": True, "sign_mode": "pfd", "mode": "lossless"}
    plan = schema.load({"version": 1, "record_length": 3, "input_encoding": "binary", "on_error": "skip-record", "fields": [spec]})
    data = frame(spark, "01234C", "012341", "0123")
    assert [r.record_index for r in decode.decode_long(data, plan).collect()] == [0]
    report = audit.report(data, plan)
    assert (report["records_seen"], report["records_valid"], report["error_distribution"], report["status"]) == (3, 1, {"E_RECORD_LENGTH": 1, "E_SIGN": 1}, "failed")
    assert report["field_profiles"]["amount"]["min_value"] == "12.34"
    with pytest.raises(decode.DataError, match="E_SIGN"):
        decode.stop_at_error(decode.decode_long(data, plan, on_error="fail"))
    full = schema.load({"version": 1, "record_length": 4, "input_encoding": "binary", "on_error": "fail", "verification_scope": "record", "fields": [spec], "fillers": [{"name": "f", "offset": 3, "length": 1}]})
    assert audit.report(frame(spark, "01234CFF"), full)["record_byte_for_byte_verified"]
    assert audit.counters(decode.decode_long(data.limit(0), plan)).first()["status"] == "empty"


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes.fromhex("01234C01235D01"))
    got = records.fixed_width(spark, str(tmp_path / "a.bin"), 3).orderBy("record_index").collect()
    assert [bytes(r.rec).hex() for r in got] == ["01234c", "01235d", "01"]
    (tmp_path / "a.hex").write_text("01234C\n\n0x01 23 5D\n0AF\n")
    got = records.hex_lines(spark, str(tmp_path / "a.hex")).orderBy("record_index").collect()
    assert [(r.record_index, r.hex_error) for r in got] == [(0, None), (1, None), (2, "E_HEX")]
    spec = {"name": "amount", "total_digits": 4, "scale": 2, "signed": True, "sign_mode": "pfd", "mode": "lossless"}
    plan = schema.load({"version": 1, "input_encoding": "jsonl", "on_error": "emit-error-row", "fields": [spec]})
    (tmp_path / "a.jsonl").write_text('{"amount":123}\n\n{"amount":"01234C"}\n{}\n[1]\nxx\n')
    rows = records.cell_rows(records.jsonl_cells(spark, str(tmp_path / "a.jsonl")), plan).orderBy("record_index").collect()
    assert [(r.error_code, r.raw_hex, r.value) for r in rows[:3]] == [("E_JSON_TYPE", "313233", None), (None, "01234C", "12.34"), ("E_REQUIRED", "", None)]
    assert [r.error_code for r in rows[3:]] == ["E_JSON", "E_JSON"]
    (tmp_path / "a.csv").write_text("amount,other\n01234C,00\n01234C\n")
    rows = records.cell_rows(records.csv_cells(spark, str(tmp_path / "a.csv"), ["amount", "other"]), plan).orderBy("record_index").collect()
    assert [(r.record_index, r.error_code) for r in rows] == [(0, None), (1, "E_CSV")]
    odo = schema.load({"version": 2, "layout_mode": "sequential", "on_error": "emit-error-row", "layout": [
        field("n", field_type="packed-decimal", total_digits=1, signed=False),
        {"kind": "occurs", "name": "t", "counter_field": "n", "min_occurs": 0, "max_occurs": 3, "element_layout": [field("c", field_type="binary", total_digits=4, signed=False)]}]})
    (tmp_path / "o.bin").write_bytes(bytes.fromhex("2F00010002" + "0F" + "9F" + "1F0007" + "1F00"))
    got = records.odo_records(spark.read.format("binaryFile").load(str(tmp_path / "o.bin")), odo).orderBy("record_index").collect()
    assert [(bytes(r.rec).hex(), r.frame_error) for r in got] == [("2f00010002", None), ("0f", None), ("9f", "E_OCCURS_COUNT"), ("1f0007", None), ("1f00", "E_RECORD_LENGTH")]
    image = records.tape_image([b"one", b"second"])
    (tmp_path / "t.tape").write_bytes(image)
    got = records.tape_records(spark.read.format("binaryFile").load(str(tmp_path / "t.tape")), 4).orderBy("record_index").collect()
    assert [bytes(r.rec) for r in got] == [b"one ", b"seco"]
    with pytest.raises(ValueError):
        list(records.tape_blocks(b"nope"))


def test_conditions_and_moves(spark):
    lit = F.lit
    assert one(spark, predicates.compare(lit("AB"), "=", lit("AB  "), text=True))
    assert one(spark, predicates.compare(lit("a"), "<", lit("A"), text=True, collation="ebcdic")) and one(spark, predicates.compare(lit("Z"), "<", lit("1"), text=True, collation="ebcdic"))
    assert one(spark, predicates.is_numeric(lit("12-"))) and not one(spark, predicates.is_numeric(lit("1 2"))) and one(spark, predicates.is_alphabetic(lit("")))
    with pytest.raises(ValueError):
        predicates.evaluate([lit(1), lit(2)], [([1], lit("x"))])
    assert one(spark, moves.move_display(lit(12345), 3)) == "345" and one(spark, moves.move_text(lit("abc"), 5)) == "abc  "
    assert one(spark, moves.reference_modified(lit("abcdef"), 2, 3)) == "bcd"
    for bad in ((0, 1), (8, None), (3, 9)):
        with pytest.raises(Exception, match="CBL-RT-REFERENCE"):
            one(spark, moves.reference_modified(lit("abcdef"), *bad))
    with pytest.raises(Exception, match="CBL-RT-SUBSCRIPT"):
        one(spark, moves.subscripted(F.array(lit(1)), 2))
    assert one(spark, moves.signed_display(lit(-5), 3)) == "-05" and one(spark, moves.read_signed_display(lit("123-"))) == -123
    assert one(spark, moves.resize_table(F.array(lit(1), lit(2)), lit(3), lit(9))) == [1, 2, 9] and one(spark, moves.resize_table(F.array(lit(1), lit(2)), lit(1), lit(9))) == [1]
    assert one(spark, F.hex(moves.move_group(raw("4142"), 4))) == "41422020"


def test_arithmetic_and_strings(spark):
    dec = lambda x: F.lit(x).cast("decimal(18,4)")
    old = F.lit("42").cast("decimal(9,2)")
    cases = [(dec("123"), 3, 0, False, "123", False), (dec("1234"), 3, 0, False, "42", True), (dec("1.26"), 3, 1, True, "1.3", False), (dec("99.6"), 2, 0, True, "42", True), (dec("1.26"), 3, 1, False, "42.0", True)]
    for value, digits, scale, rounded, want, failed in cases:
        got = one(spark, arithmetic.compute(value, old, digits, scale, rounded))
        assert (str(got["value"]), got["size_error"]) == (want, failed)
    assert one(spark, arithmetic.compute(arithmetic.divide(dec("9"), dec("0")), old, 3))["size_error"]
    with pytest.raises(Exception, match="size error"):
        one(spark, arithmetic.strict("+", dec("999"), dec("1"), 3))
    assert one(spark, strings.tally_all(F.lit("aaa"), "aa")) == 1
    got = one(spark, strings.string_into([(F.lit("ab cd"), " "), (F.lit("X"), None)], 6))
    assert (got["text"], got["pointer"], got["overflow"]) == ("abX   ", 4, False)
    got = one(spark, strings.string_into([(F.lit("XYZ"), None)], 5, F.lit("abcde"), F.lit(3)))
    assert (got["text"], got["pointer"], got["overflow"]) == ("abXYZ", 6, False)
    got = one(spark, strings.unstring(F.lit("a,,b,c"), ",", 2, every=True))
    assert (got["parts"], got["tally"], got["overflow"]) == (["a", "b"], 2, True)


def test_tables_and_files(spark):
    t = F.array(*[F.struct(F.lit(k).alias("k")) for k in (1, 3, 5, 7)])
    assert [one(spark, tables.search_all(t, "k", F.lit(v))) for v in (1, 3, 5, 7, 4)] == [1, 2, 3, 4, None]
    assert one(spark, tables.search(t, lambda e: e["k"] > 1, 3))["k"] == 5 and one(spark, tables.search(t, lambda e: e["k"] > 9)) is None
    keys = spark.createDataFrame([("10000", 0), (" 2000", 1), ("", 2)], "t string, record_index int")
    assert [r.t for r in tables.sort_records(keys, tables.display_key(F.col("t"))).collect()] == ["", " 2000", "10000"]
    lines = spark.createDataFrame([("f", i, 2) for i in range(5)], "src_file string, record_index long, n int")
    got = tables.advance(lines, F.col("n"), 5).orderBy("record_index").collect()
    assert [(r.page, r.line) for r in got] == [(1, 2), (1, 4), (2, 1), (2, 3), (2, 5)]
    assert tables.delete(keys, F.col("t") == "").count() == 2


def names_of_queries():
    from zonedeck import queries

    return sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", names_of_queries())
def test_queries_against_sql(spark, sql, name):
    """Every query gives its SQL's rows, and no generated code is too large to compile."""
    from zonedeck import queries

    cursor = sql.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sorted(got.columns) == sorted(names)
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(cursor.fetchall(), key=key)
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
