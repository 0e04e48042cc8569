"""Record sources: fixed-width, hexadecimal lines, CSV and JSONL cells, variable-length tables, tape images.

Each gives (record_index, rec), numbered in file order, or named cells where records
aren't byte strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_hex
from ..operators.decode import finish, slim
from ..plans.schema import MAX_RECORD_BYTES, Codec, Occurs, Plan

#: Files up to this size are read whole and cut as Arrow arrays; larger ones are split by record boundaries.
WHOLE_FILE = 128 << 20
#: Records that leave a task at once.
RECORDS = 20_000
#: Bytes at most that a larger file with a partial tail is read in at once.
PIECE = 64 << 10
#: Fixed value: what a tape image begins with.
TAPE_MAGIC = b"COBOLVM-TAPE-1\n"


def cut_files(files: DataFrame, length: int) -> DataFrame:
    """(src_file, record_index, rec) of files (path, content); a partial record at a file's end is kept, shorter.

    The records are stretches of the content itself: an Arrow array over it, nothing is copied a record.
    (Slicing in an expression copies the whole content for each record.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                content = batch.column(1)[k].as_buffer()
                whole = content.size // length if content is not None else 0
                fixed = pa.Array.from_buffers(pa.binary(length), whole, [None, content])
                for at in range(0, whole, RECORDS):
                    some = fixed.slice(at, RECORDS).cast(pa.binary())
                    yield _records(path, at, some)
                if content is not None and content.size % length:
                    yield _records(path, whole, pa.array([content.slice(whole * length).to_pybytes()], pa.binary()))

    return files.select("path", "content").mapInArrow(run, "src_file string, record_index long, rec binary")


def _records(path: str, first: int, recs: pa.Array) -> pa.RecordBatch:
    index = pa.array(range(first, first + len(recs)), pa.int64())
    return pa.record_batch([pa.array([path] * len(recs), pa.string()), index, recs], names=["src_file", "record_index", "rec"])


def fixed_width(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(src_file, record_index, rec) of fixed-width files. A partial tail is a short record, which decoding reports and which is a file's last."""
    files = spark.read.format("binaryFile").load(path)
    # Sizes alone: the contents aren't read for this.
    large = files.filter(F.col("length") > WHOLE_FILE).select("path", "length").collect()
    small = files.filter(F.col("length") <= WHOLE_FILE)
    out = cut_files(small, length)
    for file in large:
        out = out.unionByName(split_file(spark, file["path"], file["length"], length))
    return out


def in_file_order(records: DataFrame, spark: SparkSession, path: str, length: int) -> DataFrame:
    """Fixed-width records numbered on from file to file, by name, as one file: (record_index, rec)."""
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("src_file"), F.ceil(F.col("length") / length).alias("n"))
    before = Window.orderBy("src_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    base = sizes.select("src_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return records.join(F.broadcast(base), "src_file").select((F.col("record_index") + F.col("base")).alias("record_index"), "rec")


def split_file(spark: SparkSession, path: str, size: int, length: int) -> DataFrame:
    """The same of one file, read in splits. Spark's splitting reader needs pieces that divide the file.

    Without a partial tail these are the records; otherwise they are cut at the records'
    ends, and only the parts of records that lie in two pieces or more are dealt.
    """
    piece = length if size % length == 0 else next(n for n in range(PIECE, 0, -1) if size % n == 0)
    escaped = "".join(f"\\{c}" if c in "\\{}[]*?" else c for c in path)
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(piece)}
    read = spark.sparkContext.newAPIHadoopFile(escaped, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def cut(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytearray]]:
        for k, data in pieces:
            at, end = k * piece, (k + 1) * piece
            while at < end:
                stop = min(end, (at // length + 1) * length)
                yield at // length, at, bytearray(data[at - k * piece : stop - k * piece])
                at = stop

    parts = spark.createDataFrame(read.mapPartitions(cut), "record_index long, at long, rec binary")
    if piece != length:
        due = F.least(F.lit(length), F.lit(size) - F.col("record_index") * length)
        whole = F.octet_length("rec") == due
        dealt = parts.filter(~whole).groupBy("record_index").agg(F.array_sort(F.collect_list(F.struct("at", "rec"))).alias("p"))
        joined = dealt.select("record_index", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["rec"])).alias("rec"))
        parts = parts.filter(whole).select("record_index", "rec").unionByName(joined)
    return parts.select(F.lit(path).alias("src_file"), "record_index", "rec")


def lines(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """(src_file, record_index, line) of text files: numbered within each split, then shifted by the splits before it."""
    raw = spark.read.text(path).select(F.input_file_name().alias("src_file"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    if skip_blank:
        raw = raw.filter(F.trim("line") != "")
    numbered = raw.withColumn("at", F.row_number().over(Window.partitionBy("src_file", "split").orderBy("m")) - 1)
    before = Window.partitionBy("src_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = raw.groupBy("src_file", "split").agg(F.count("*").alias("n")).select("src_file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(base, ["src_file", "split"]).select("src_file", (F.col("base") + F.col("at")).cast("long").alias("record_index"), "line")


def hex_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record_index, rec, hex_error, line)."""
    got = parse_hex(F.col("line"))
    return lines(spark, path).select("record_index", got["bytes"].alias("rec"), got["error_code"].alias("hex_error"), "line")


def jsonl_cells(spark: SparkSession, path: str) -> DataFrame:
    """(record_index, cells map<string,string>, kinds, error_code, line): cells hold strings only, kinds every value's type."""
    return json_cells(lines(spark, path))


def json_cells(rows: DataFrame) -> DataFrame:
    parsed = F.try_parse_json("line")
    kind = F.schema_of_variant(parsed)
    good = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    cells = F.when(good, F.from_json("line", "map<string,string>"))
    # A string's JSON text begins with a quote; from_json() gives strings bare and the rest as JSON.
    return rows.select("record_index", cells.alias("cells"), F.when(~good, "E_JSON").alias("error_code"), "line", F.when(good, parsed).alias("object"))


def csv_cells(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """(record_index, cells, error_code, line) of the lines after the header; a wrong number of cells is E_CSV."""
    cells = F.split("line", ",", -1)
    named = F.map_from_arrays(F.array(*map(F.lit, header)), F.transform(F.slice(cells, 1, len(header)), lambda x: F.trim(x)))
    body = lines(spark, path).filter("record_index > 0").withColumn("record_index", F.col("record_index") - 1)
    bad = F.size(cells) != len(header)
    return body.select("record_index", F.when(~bad, named).alias("cells"), F.when(bad, "E_CSV").alias("error_code"), "line")


def cell_rows(cells: DataFrame, plan: Plan, verify: bool = False) -> DataFrame:
    """The long relation (with pos) of named hex cells: missing required cells are E_REQUIRED, missing optional ones no row."""
    none, empty = F.lit(None).cast("string"), F.unhex(F.lit(""))
    typed = "object" in cells.columns
    df = cells.withColumns({f"_p{k}": parse_hex(F.col("cells")[f.path]) for k, f in enumerate(plan.fields)})
    df = df.withColumns({f"_g{k}": f.codec.decode(F.col(f"_p{k}.bytes")) for k, f in enumerate(plan.fields)})
    codes = {}
    for k, f in enumerate(plan.fields):
        hexed, got = F.col(f"_p{k}"), F.col(f"_g{k}")
        steps = F.when(F.col("cells")[f.path].isNull(), "E_REQUIRED")
        if typed:
            kind = F.schema_of_variant(F.try_variant_get("object", f"$['{f.path}']", "variant"))
            steps = steps.when(kind != "STRING", "E_JSON_TYPE")
        steps = steps.when(hexed["error_code"].isNotNull(), hexed["error_code"]).when(got["error_code"].isNotNull(), got["error_code"])
        codes[f"_e{k}"] = steps.when(~f.codec.verifies(hexed["bytes"], got), "E_VERIFY") if verify else steps
    df = df.withColumns(codes)
    arrays = []
    for k, f in enumerate(plan.fields):
        code, got, cell = F.col(f"_e{k}"), F.col(f"_g{k}"), F.col("cells")[f.path]
        data = F.when(code == "E_JSON_TYPE", F.encode(cell, "UTF-8")).when(code.isin("E_REQUIRED", "E_HEX"), empty).otherwise(F.col(f"_p{k}.bytes"))
        one = F.array(slim(F.lit(f.path), F.lit(None), data, f.codec.as_text(got["value"]), got["sign_nibble"], got["sign_class"], code))
        arrays.append(one if f.required else F.when(code == "E_REQUIRED", F.slice(one, 1, 0)).otherwise(one))
    whole = F.array(slim(F.lit("<record>"), F.lit(None), F.encode("line", "UTF-8"), none, none, none, F.col("error_code")))
    rows = F.when(F.col("error_code").isNotNull(), whole).otherwise(F.concat(*arrays))
    return finish(df.select("record_index", rows.alias("rows")))


def counted_value(codec: Codec, data: bytes) -> int | None:
    """A counter's value from its bytes, null if they are bad: what framing needs, by the rules of the column codecs."""
    s = codec.shape
    if codec.kind == "packed-decimal":
        from ..functions.packed import ACCEPTED

        h = data.hex().upper()
        digits, sign = h[:-1], h[-1]
        if not digits.isdigit() or sign not in ACCEPTED[s.mode, s.signed] or s.digits % 2 == 0 and digits[0] != "0":
            return None
        return -int(digits) if sign in "BD" else int(digits)
    if codec.kind == "zoned-decimal":
        h = data.hex().upper()
        if s.encoding == "ebcdic":
            ok = all(h[k] == "F" for k in range(0, len(h) - 2, 2)) and h[1::2].isdigit() and h[-2] in ("CFD" if s.signed else "CF")
            return (-1 if h[-2] == "D" else 1) * int(h[1::2]) if ok else None
        text = data.decode("latin-1").translate(str.maketrans("{ABCDEFGHI}JKLMNOPQR", "01234567890123456789"))
        return int(text) if text.isdigit() else None
    return int.from_bytes(data, s.endian, signed=s.signed)


def frame_odo(content: bytes, plan: Plan) -> Iterator[tuple[int, bytes, str | None]]:
    """(record_index, bytes, error) of variable-length records. After a bad counter the next record begins right after the header."""
    tables = [i for i in plan.items if isinstance(i, Occurs)]
    fixed = max([plan.header_length, *(i.offset + i.length for i in plan.items if not isinstance(i, Occurs))])
    at = index = 0
    while at < len(content):
        head = content[at : at + plan.header_length]
        if len(head) < plan.header_length:
            yield index, head, "E_RECORD_LENGTH"
            return
        n = fixed
        for t in tables:
            c = t.counter
            count = counted_value(c.codec, head[c.offset : c.offset + c.length])
            if count is None or not t.low <= count <= t.high:
                n = None
                break
            n = max(n, t.offset + count * t.element_len)
        if n is None or n > MAX_RECORD_BYTES:
            yield index, head, "E_OCCURS_COUNT" if n is None else "E_RECORD_LENGTH"
            at += plan.header_length
        else:
            rec = content[at : at + n]
            yield index, rec, None if len(rec) == n else "E_RECORD_LENGTH"
            at += n
        index += 1


def odo_records(files: DataFrame, plan: Plan) -> DataFrame:
    """(src_file, record_index, rec, frame_error) of files (path, content). Framing is sequential within a file; files are read in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src_file", "record_index", "rec", "frame_error"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some: list[tuple] = []
                for index, rec, error in frame_odo(content or b"", plan):
                    some.append((path, index, rec, error))
                    if len(some) == 10_000:
                        yield _batch(some, names)
                        some = []
                if some:
                    yield _batch(some, names)

    return files.select("path", "content").mapInArrow(run, "src_file string, record_index long, rec binary, frame_error string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def tape_blocks(content: bytes, length: int | None = None) -> Iterator[bytes]:
    """The blocks of a tape image, padded or cut to the record length."""
    if not content.startswith(TAPE_MAGIC):
        raise ValueError("CBL-RT-FILE: not a tape image")
    at = len(TAPE_MAGIC)
    while at < len(content):
        if content[at : at + 1] != b"D" or at + 9 > len(content):
            raise ValueError("CBL-RT-FILE: bad tape block")
        n = int.from_bytes(content[at + 1 : at + 9], "little")
        block = content[at + 9 : at + 9 + n]
        if len(block) < n:
            raise ValueError("CBL-RT-FILE: truncated tape block")
        yield block if length is None else block[:length].ljust(length)
        at += 9 + n


def tape_block(data: bytes) -> bytes:
    return b"D" + len(data).to_bytes(8, "little") + data


def tape_image(blocks: list[bytes]) -> bytes:
    return TAPE_MAGIC + b"".join(map(tape_block, blocks))


def tape_records(files: DataFrame, length: int | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some = [(path, k, b, None) for k, b in enumerate(tape_blocks(content, length))]
                if some:
                    yield _batch(some, ["src_file", "record_index", "rec", "frame_error"])

    return files.select("path", "content").mapInArrow(run, "src_file string, record_index long, rec binary, frame_error string")
