"""Sinks and the record stream."""

from pathlib import Path

import pytest

from zonedeck.operators import audit, decode
from zonedeck.plans import schema
from zonedeck.sources import records, sinks
from zonedeck.streaming import ingest

PLAN = schema.load({"version": 1, "record_length": 3, "input_encoding": "binary", "on_error": "emit-error-row", "fields": [{"name": "a", "offset": 0, "total_digits": 4, "scale": 2, "signed": True, "sign_mode": "pfd", "mode": "lossless"}]})


def test_fixed_width_and_tape_round_trip(spark, tmp_path):
    data = [(i, bytearray(bytes.fromhex(f"0{i:04d}C"))) for i in range(500)]
    df = spark.createDataFrame(data, "record_index long, rec binary").repartition(7)
    sinks.write_fixed_width(df, str(tmp_path / "out"))
    whole = b"".join(p.read_bytes() for p in sorted(Path(tmp_path / "out").glob("part-*.bin")))
    assert whole == b"".join(bytes(b) for _, b in data)
    sinks.write_tape(df.filter("record_index < 3"), str(tmp_path / "t"))
    assert list(records.tape_blocks((tmp_path / "t" / "part-00000.bin").read_bytes())) == [bytes(b) for _, b in data[:3]]


def test_row_and_audit_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, bytearray(bytes.fromhex("01234C"))), (1, bytearray(bytes.fromhex("012341")))], "record_index long, rec binary")
    rows = decode.decode_long(df, PLAN)
    for form in ("jsonl", "csv"):
        sinks.write_rows(rows, str(tmp_path / form), form)
        sinks.write_rows(rows, str(tmp_path / form), form, "append")
    assert spark.read.json(str(tmp_path / "jsonl")).count() == spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    assert sinks.json_document(rows).count('"field":"a"') == 2
    report = audit.report(df, PLAN)
    assert "E_SIGN" in sinks.audit_json(report) and "distinct_error_codes" in sinks.audit_csv(report)
    assert sinks.inspect(bytes.fromhex("01234D"))["negative"]
    with pytest.raises(ValueError):
        sinks.write_rows(rows, "x", "xml")


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    go = lambda: ingest.decode_stream(spark, str(folder), PLAN, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (folder / "a.bin").write_bytes(bytes.fromhex("01234C01235D"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (folder / "b.bin").write_bytes(bytes.fromhex("01236C01"))
    go()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.filter("error_code = 'E_RECORD_LENGTH'").count() == 1


def test_large_fixed_width_files_give_the_same_rows(spark, tmp_path, monkeypatch):
    """Names, numbers and short tails don't depend on a file's size; sizes of 700, 707, 701 (prime) and 5 bytes, records of 7."""
    for name, size in (("a", 700), ("b [1]", 707), ("c", 701), ("d", 5), ("e", 1202)):
        (tmp_path / f"{name}.bin").write_bytes(bytes((k * 31 + size) % 256 for k in range(size)))
    (tmp_path / "f.bin").write_bytes(b"")

    def rows():
        return sorted((r.src_file, r.record_index, bytes(r.rec)) for r in records.fixed_width(spark, str(tmp_path), 7).collect())

    want = rows()
    assert len(want) == 100 + 101 + 101 + 1 + 172
    for limit, piece in ((600, 1 << 16), (600, 40), (703, 40)):  # 40: records that lie in several pieces
        monkeypatch.setattr(records, "WHOLE_FILE", limit)
        monkeypatch.setattr(records, "PIECE", piece)
        assert rows() == want
