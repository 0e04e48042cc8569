"""Records to rows: the long relation (a row a field), the wide one (a column a field), and back to bytes.

A plan becomes projections of built-in expressions over the record's bytes; there is no
shuffle and no Python on the way. Records with tables are cut into their fields' bytes
first, a row each, and the rows decoded after that by the codec they need, so that a codec's
expression stands in the plan once however many elements a record has. Only skipping
records with tables decodes inside arrays, because there a record's rows must stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packed import sign_class
from ..plans.schema import Codec, Field, Gap, Item, Occurs, Plan, Redefines

VERSION = 1
#: Bytes of raw data that a row shows, and the long relation's columns.
RAW_BYTES = 64
COLUMNS = (
    "version", "record_index", "field", "offset", "raw_hex", "raw_byte_len", "raw_hex_truncated",
    "value", "sign_nibble", "sign_class", "valid", "error_code", "message", "recoverable",
)
MESSAGES = {
    "E_LENGTH": "wrong number of bytes for the field",
    "E_PADDING": "pad nibble isn't zero",
    "E_DIGIT": "invalid digit",
    "E_SIGN": "invalid sign",
    "E_ENCODING": "text has rejected bytes",
    "E_OFFSET": "field lies past the record's end",
    "E_VERIFY": "re-encoded bytes differ",
    "E_RECORD_LENGTH": "record length mismatch",
    "E_OCCURS_COUNT": "OCCURS counter is not an allowed count",
    "E_REQUIRED": "required field is missing",
    "E_JSON": "line is not a JSON object",
    "E_JSON_TYPE": "JSONL field must be a string containing hex bytes",
    "E_CSV": "wrong number of CSV fields",
    "E_HEX": "invalid hex",
}


class DataError(ValueError):
    """Data that on_error=fail stops at (exit code 1)."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def message_of(code: Column) -> Column:
    out = None
    for k, text in MESSAGES.items():
        out = F.when(code == k, text) if out is None else out.when(code == k, text)
    return out


def slim(field: Column, offset: Column, data: Column, value: Column, nibble: Column, kind: Column, error: Column) -> Column:
    """What a row of the long relation follows from; finish() adds the rest once rows stand for themselves."""
    return F.struct(
        field.alias("field"), offset.cast("int").alias("offset"), data.alias("data"), value.alias("value"),
        nibble.alias("sign_nibble"), kind.alias("sign_class"), error.alias("error_code"),
    )


def finish(rows: DataFrame) -> DataFrame:
    """The long relation, with pos, from (record_index, rows). A failed row shows its last byte's low nibble, whatever its codec."""
    # outer: else the optimizer adds a filter on the array's size, which doubles the whole expression.
    return finished(rows.select("record_index", F.posexplode_outer("rows").alias("pos", "r")).filter("pos IS NOT NULL").select("record_index", "pos", "r.*"))


def finished(flat: DataFrame) -> DataFrame:
    """finish() of rows that stand for themselves already."""
    flat = flat.withColumn("data", F.coalesce("data", F.unhex(F.lit(""))))
    bad, last = F.col("error_code").isNotNull(), F.right(F.hex("data"), F.lit(1))
    some = F.octet_length("data") > 0
    out = flat.select(
        F.lit(VERSION).alias("version"), "record_index", "field", "offset",
        F.hex(F.substring("data", 1, RAW_BYTES)).alias("raw_hex"), F.octet_length("data").alias("raw_byte_len"), (F.octet_length("data") > RAW_BYTES).alias("raw_hex_truncated"),
        F.when(~bad, F.col("value")).alias("value"),
        F.when(~bad, F.col("sign_nibble")).when(some, F.concat(F.lit("0x"), last)).alias("sign_nibble"),
        F.when(~bad, F.col("sign_class")).when(some, sign_class(last, F.lit(True))).alias("sign_class"),
        (~bad).alias("valid"), "error_code", message_of(F.col("error_code")).alias("message"), bad.alias("recoverable"), "pos",
    )
    return out.select(*COLUMNS, "pos")


def bytes_at(rec: Column, offset: Column | int, length: int) -> Column:
    """The bytes [offset, offset + length), null if the record ends before."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(F.octet_length(rec) >= offset + length, F.substring(rec, (offset + 1).cast("int"), F.lit(length)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def error_of(f: Field, data: Column, got: Column, verify: bool) -> Column:
    error = F.when(data.isNull(), "E_OFFSET").otherwise(got["error_code"])
    return F.when(error.isNotNull(), error).when(~f.codec.verifies(data, got), "E_VERIFY") if verify else error


def field_row(f: Field, rec: Column, base: Column, name: Column, verify: bool) -> Column:
    offset = base + f.offset

    def shown(x: Column) -> Column:
        got = x["got"]
        return slim(name, offset, x["data"], f.codec.as_text(got["value"]), got["sign_nibble"], got["sign_class"], x["error"])

    def judged(x: Column) -> Column:
        return let(F.struct(x["data"].alias("data"), x["got"].alias("got"), error_of(f, x["data"], x["got"], verify).alias("error")), shown)

    return let(bytes_at(rec, offset, f.length), lambda data: let(F.struct(data.alias("data"), f.codec.decode(data).alias("got")), judged))


def count_of(t: Occurs, rec: Column) -> Column:
    """The table's count, null if its counter is bad or out of bounds."""
    value = t.counter.codec.decode(bytes_at(rec, t.counter.offset, t.counter.length))["value"].cast("int")
    return F.when(value.between(t.low, t.high), value)


def _indices(n: Column) -> Column:
    """0 .. n - 1; sequence() counts down for an empty range, hence the guard."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def table_rows(t: Occurs, rec: Column, base: Column, name, verify: bool) -> Column:
    """The rows of a table's elements; name(path) gives a field's shown name."""

    def element(i: Column) -> Column:
        inner = lambda path: F.concat(name(t.path), F.lit("["), i.cast("string"), F.lit("]"), F.lit(path[len(t.path) + 2 :]))
        at = base + t.offset + i * t.element_len
        parts = []
        for item in t.items:
            if isinstance(item, Field):
                parts.append(F.array(field_row(item, rec, at, inner(item.path), verify)))
            elif isinstance(item, Occurs):
                parts.append(table_rows(item, rec, at, inner, verify))
            elif isinstance(item, Redefines):
                for v in item.variants:
                    parts += [F.array(field_row(f, rec, at + item.offset, inner(f.path), verify)) for f in v.items if isinstance(f, Field)]
        return F.concat(*parts)

    return F.flatten(F.transform(_indices(count_of(t, rec)), element))


def slots(items, base: int = 0, selector=None) -> list[tuple[Field, int, object] | Occurs]:
    """What gives rows, in order: fields with their absolute offset and the selector they stand under, and tables."""
    out: list = []
    for item in items:
        if isinstance(item, Field):
            out.append((item, base + item.offset, selector))
        elif isinstance(item, Occurs):
            out.append(item)
        elif isinstance(item, Redefines):
            for v in item.variants:
                out += slots(v.items, base + item.offset, v.selector or selector)
    return out


def record_error(plan: Plan, rec: Column) -> Column:
    """Code of what is wrong with the record as a whole, null if nothing is."""
    if not plan.has_occurs:
        return F.when(F.octet_length(rec) != (plan.record_length or plan.max_length), "E_RECORD_LENGTH")
    bad = F.lit(False)
    for t in plan.items:
        if isinstance(t, Occurs):
            bad = bad | count_of(t, rec).isNull()
    return F.when(bad, "E_OCCURS_COUNT").when(F.octet_length(rec) != actual_length(plan, rec), "E_RECORD_LENGTH")


def actual_length(plan: Plan, rec: Column) -> Column:
    """Bytes of a record with tables at their counts."""
    ends = [F.lit(plan.header_length)]
    for item in plan.items:
        ends.append(F.lit(item.offset) + count_of(item, rec) * item.element_len if isinstance(item, Occurs) else F.lit(item.offset + item.length))
    return F.greatest(*ends) if len(ends) > 1 else ends[0]


def with_rows(records: DataFrame, plan: Plan, verify: bool = False, fields: list[str] | None = None) -> DataFrame:
    """(record_index, rows): all rows of a record in layout order; a record that is bad as a whole has one, '<record>'.

    Bytes, decoded values, codes and rows are steps of their own, so that each expression
    refers to columns and is computed once. fields: only these top-level items.
    """
    found = slots([i for i in plan.items if not fields or i.path in fields])
    rec, none = F.col("rec"), F.lit(None).cast("string")
    plain = [(k, *x) for k, x in enumerate(found) if isinstance(x, tuple)]
    df = records.select("record_index", "rec", record_error(plan, rec).alias("_whole"), *[bytes_at(rec, at, f.length).alias(f"_d{k}") for k, f, at, _ in plain])
    df = df.withColumns({f"_g{k}": f.codec.decode(F.col(f"_d{k}")) for k, f, _, _ in plain})
    df = df.withColumns({f"_e{k}": error_of(f, F.col(f"_d{k}"), F.col(f"_g{k}"), verify) for k, f, _, _ in plain})
    arrays = []
    for k, x in enumerate(found):
        if isinstance(x, Occurs):
            arrays.append(table_rows(x, rec, F.lit(0), lambda path: F.lit(path), verify))
            continue
        f, at, selector = x
        shown, got = F.lit(f.path), F.col(f"_g{k}")
        if selector:
            by, want = selector
            value = by.codec.as_text(by.codec.decode(bytes_at(rec, by.offset, by.length))["value"])
            shown = F.concat(shown, F.when(value == want, ":selector-active").otherwise(":selector-inactive"))
        arrays.append(F.array(slim(shown, F.lit(at), F.col(f"_d{k}"), f.codec.as_text(got["value"]), got["sign_nibble"], got["sign_class"], F.col(f"_e{k}"))))
    bad = F.array(slim(F.lit("<record>"), F.octet_length(rec), rec, none, none, none, F.col("_whole")))
    return df.select("record_index", F.when(F.col("_whole").isNotNull(), bad).otherwise(F.concat(*arrays)).alias("rows"))


def pieces(plan: Plan, rec: Column, fields: list[str] | None = None) -> tuple[Column, list[Codec]]:
    """(array of (codec, field, offset, data) of a record with tables, the codecs): the bytes of each row of the long relation."""
    codecs: list[Codec] = []

    def piece(f: Field, name: Column, at: Column) -> Column:
        if f.codec not in codecs:
            codecs.append(f.codec)
        return F.struct(F.lit(codecs.index(f.codec)).alias("codec"), name.alias("field"), at.cast("int").alias("offset"), bytes_at(rec, at, f.length).alias("data"))

    def of_table(t: Occurs, base: Column, name) -> Column:
        def element(i: Column) -> Column:
            inner = lambda path: F.concat(name(t.path), F.lit("["), i.cast("string"), F.lit("]"), F.lit(path[len(t.path) + 2 :]))
            at = base + t.offset + i * t.element_len
            parts = []
            for item in t.items:
                if isinstance(item, Occurs):
                    parts.append(of_table(item, at, inner))
                elif isinstance(item, (Field, Redefines)):
                    inside = [item] if isinstance(item, Field) else [f for v in item.variants for f in v.items if isinstance(f, Field)]
                    shift = 0 if isinstance(item, Field) else item.offset
                    parts.append(F.array(*[piece(f, inner(f.path), at + shift + f.offset) for f in inside]))
            return F.concat(*parts)

        return F.flatten(F.transform(_indices(count_of(t, rec)), element))

    arrays = []
    for x in slots([i for i in plan.items if not fields or i.path in fields]):
        if isinstance(x, Occurs):
            arrays.append(of_table(x, F.lit(0), lambda path: F.lit(path)))
            continue
        f, at, selector = x
        shown = F.lit(f.path)
        if selector:
            by, want = selector
            value = by.codec.as_text(by.codec.decode(bytes_at(rec, by.offset, by.length))["value"])
            shown = F.concat(shown, F.when(value == want, ":selector-active").otherwise(":selector-inactive"))
        arrays.append(F.array(piece(f, shown, F.lit(at))))
    return F.concat(*arrays), codecs


def decoded_pieces(records: DataFrame, plan: Plan, verify: bool = False, fields: list[str] | None = None) -> DataFrame:
    """The long relation, with pos, of a plan with tables: rows first, then their decoding."""
    rec, none = F.col("rec"), F.lit(None).cast("string")
    found, codecs = pieces(plan, rec, fields)
    held = records.select("record_index", "rec", record_error(plan, rec).alias("_whole"))
    bad = F.array(F.struct(F.lit(-1).alias("codec"), F.lit("<record>").alias("field"), F.octet_length(rec).alias("offset"), rec.alias("data")))
    cut = held.select("record_index", "_whole", F.when(F.col("_whole").isNotNull(), bad).otherwise(found).alias("pieces"))
    rows = cut.select("record_index", "_whole", F.posexplode_outer("pieces").alias("pos", "p")).filter("pos IS NOT NULL").select("record_index", "_whole", "pos", "p.*")
    data, of = F.col("data"), F.col("codec")
    rows = rows.withColumns({f"_g{k}": F.when(of == k, c.decode(data)) for k, c in enumerate(codecs)})

    def chosen(each) -> Column:
        out = F.when(of == -1, none)
        for k, c in enumerate(codecs):
            out = out.when(of == k, each(c, F.col(f"_g{k}")))
        return out

    error = F.when(of == -1, F.col("_whole")).when(data.isNull(), "E_OFFSET").otherwise(chosen(lambda c, got: got["error_code"]))
    columns = {"value": chosen(lambda c, got: c.as_text(got["value"])), "sign_nibble": chosen(lambda c, got: got["sign_nibble"]), "sign_class": chosen(lambda c, got: got["sign_class"])}
    rows = rows.withColumns(columns | {"error_code": error})
    if verify:
        same = F.when(of == -1, F.lit(True))
        for k, c in enumerate(codecs):
            same = same.when(of == k, c.verifies(data, F.col(f"_g{k}")))
        rows = rows.withColumn("error_code", F.when(F.col("error_code").isNull() & ~same, "E_VERIFY").otherwise(F.col("error_code")))
    return finished(rows.select("record_index", "pos", "field", "offset", "data", "value", "sign_nibble", "sign_class", "error_code"))


def _applied(rows: Column, on_error: str, audit: bool = False) -> Column:
    """Rows that on_error lets through. For the audit a skipped record counts with its first bad row only."""
    if on_error != "skip-record":
        return rows
    bad = F.filter(rows, lambda r: r["error_code"].isNotNull())
    return F.when(F.size(bad) == 0, rows).otherwise(F.slice(bad, 1, 1) if audit else F.slice(rows, 1, 0))


def decode_long(records: DataFrame, plan: Plan, verify: bool = False, on_error: str | None = None, audit: bool = False, max_records: int | None = None, fields: list[str] | None = None) -> DataFrame:
    """The long relation of records (record_index, rec), with pos, the place of a row within its record.

    on_error=fail lets all rows through; see stop_at_error(). max_records counts by record_index.
    """
    if max_records is not None:
        if max_records < 1:
            raise ValueError("E_CONFIG: max_records must be positive")
        records = records.filter(F.col("record_index") < max_records)
    if plan.has_occurs and (on_error or plan.on_error) != "skip-record":
        return decoded_pieces(records, plan, verify, fields)
    rows = with_rows(records, plan, verify, fields)
    return finish(rows.withColumn("rows", _applied(F.col("rows"), on_error or plan.on_error, audit)))


def stop_at_error(rows: DataFrame) -> None:
    """Raise for the first invalid row in record order, if there is one: a minimum, not a race."""
    first = rows.filter("NOT valid").agg(F.min_by(F.struct("error_code", "message"), F.struct("record_index", "pos")).alias("e")).first()["e"]
    if first is not None:
        raise DataError(first["error_code"], first["message"])


def wide_value(item: Item, rec: Column, base: Column) -> Column:
    if isinstance(item, Field):
        return item.codec.decode(bytes_at(rec, base + item.offset, item.length))["value"]
    if isinstance(item, Occurs):
        return F.transform(_indices(count_of(item, rec)), lambda i: wide_struct(item.items, rec, base + item.offset + i * item.element_len, item.path + "[]."))
    return F.struct(*[wide_struct(v.items, rec, base + item.offset, f"{item.path}.{v.name}.").alias(v.name) for v in item.variants])


def wide_struct(items, rec: Column, base: Column, prefix: str) -> Column:
    return F.struct(*[wide_value(i, rec, base).alias(i.path.removeprefix(prefix)) for i in items if not isinstance(i, Gap)])


def decode_wide(records: DataFrame, plan: Plan) -> DataFrame:
    """A typed column for each top-level item: tables are arrays of structs, redefinitions a struct of variants. Bad values are null."""
    return records.select("record_index", *[wide_value(i, F.col("rec"), F.lit(0)).alias(i.path) for i in plan.items if not isinstance(i, Gap)])


def decode_elements(records: DataFrame, plan: Plan, table: str) -> DataFrame:
    """(record_index, the fields beside tables, idx, the table's fields): a row an element, idx from 0, a null one where the table is empty.

    Records that are bad as a whole are left out; bad values are null.
    """
    t = next(i for i in plan.items if isinstance(i, Occurs) and i.path == table)
    rec = F.col("rec")
    outside = [i for i in plan.items if isinstance(i, Field)]
    held = records.filter(record_error(plan, rec).isNull()).select("record_index", "rec", F.posexplode_outer(_cut_elements(t, rec)).alias("idx", "_element"))
    inside = [i for i in t.items if isinstance(i, Field)]
    return held.select(
        "record_index", *[f.codec.decode(bytes_at(rec, f.offset, f.length))["value"].alias(f.path) for f in outside], "idx",
        *[f.codec.decode(F.substring("_element", f.offset + 1, f.length))["value"].alias(f.path.removeprefix(t.path + "[].")) for f in inside],
    )


def _cut_elements(t: Occurs, rec: Column) -> Column:
    return F.transform(_indices(count_of(t, rec)), lambda i: F.substring(rec, F.lit(t.offset + 1) + i * t.element_len, F.lit(t.element_len)))


def typed_view(records: DataFrame, plan: Plan, name: str) -> None:
    """The wide relation as a temporary view."""
    decode_wide(records, plan).createOrReplaceTempView(name)


def pack_record(plan: Plan, values: dict[str, Column], filler: int = 0) -> Column:
    """The bytes of a record from its fields' values (tables: arrays of structs by field name)."""
    parts, at = [], 0
    for item in sorted((i for i in plan.items if not isinstance(i, Redefines)), key=lambda i: i.offset):
        if item.offset > at:
            parts.append(F.lit(bytes([filler]) * (item.offset - at)))
        if isinstance(item, Field):
            parts.append(item.codec.encode(values[item.path]))
        elif isinstance(item, Gap):
            parts.append(F.lit(bytes([filler]) * item.length))
        else:
            parts.append(_packed_table(item, values[item.path]))
        at = item.offset + item.length
    return F.concat(*parts)


def _packed_table(t: Occurs, elements: Column) -> Column:
    names = [i for i in t.items if isinstance(i, Field)]
    one = lambda e: F.hex(F.concat(*[f.codec.encode(e[f.path.removeprefix(t.path + "[].")]) for f in names]))
    return F.unhex(F.array_join(F.transform(elements, one), ""))
