"""The command line's results and exit codes."""

import json

import pytest

from zonedeck import cli
from zonedeck.sources import binding

SCHEMA = {"version": 1, "record_length": 3, "input_encoding": "binary", "on_error": "emit-error-row", "fields": [{"name": "a", "offset": 0, "total_digits": 4, "scale": 2, "signed": True, "sign_mode": "pfd", "mode": "lossless"}]}


def test_field_commands(spark, capsys, tmp_path):
    assert cli.main(["decode", "--digits", "4", "--scale", "2", "--hex", "01234D"]) == cli.OK
    assert json.loads(capsys.readouterr().out)["value"] == "-12.34"
    assert cli.main(["decode", "--digits", "4", "--hex", "01234A"]) == cli.DATA
    assert cli.main(["decode", "--digits", "4", "--hex", "zz"]) == cli.DATA
    assert cli.main(["decode", "--digits", "4"]) == cli.CONFIG and cli.main(["decode", "--digits", "40", "--hex", "0C"]) == cli.CONFIG
    assert cli.main(["decode"]) == cli.CONFIG and cli.main([]) == cli.CONFIG
    assert cli.main(["decode", "--digits", "4", "--file", str(tmp_path / "none")]) == cli.IO
    (tmp_path / "f").write_bytes(bytes.fromhex("FF01234C"))
    capsys.readouterr()
    assert cli.main(["inspect", "--digits", "4", "--file", str(tmp_path / "f"), "--offset", "1"]) == cli.OK
    assert json.loads(capsys.readouterr().out)["sign_nibble"] == "0xC"
    assert cli.main(["encode", "--digits", "4", "--scale", "2", "--value", "-1.5"]) == cli.OK
    assert capsys.readouterr().out.strip() == "00150D"
    assert cli.main(["encode", "--digits", "2", "--value", "100"]) == cli.DATA and cli.main(["encode", "--digits", "2", "--value", "x"]) == cli.DATA


def test_batch_and_schema_commands(spark, capsys, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    (tmp_path / "good.bin").write_bytes(bytes.fromhex("01234C01235D"))
    (tmp_path / "bad.bin").write_bytes(bytes.fromhex("01234C012351"))
    run = lambda action, name, *more: cli.main(["batch", action, "--schema", str(tmp_path / "s.json"), "--input", str(tmp_path / name), *more])
    assert run("decode", "good.bin", "--output", str(tmp_path / "out")) == cli.OK and spark.read.json(str(tmp_path / "out")).count() == 2
    assert run("verify", "good.bin") == cli.OK
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["records_seen"] == 2
    assert run("verify", "bad.bin") == cli.DATA and run("verify", "none.bin") == cli.IO
    assert cli.main(["profile", "--schema", str(tmp_path / "s.json"), "--input", str(tmp_path / "good.bin")]) == cli.OK
    assert cli.main(["schema", "check", str(tmp_path / "s.json")]) == cli.OK
    (tmp_path / "t.json").write_text(json.dumps(SCHEMA | {"version": 9}))
    assert cli.main(["schema", "check", str(tmp_path / "t.json")]) == cli.CONFIG and cli.main(["schema", "check", str(tmp_path / "no")]) == cli.IO
    assert cli.main(["schema", "compare", str(tmp_path / "s.json"), str(tmp_path / "s.json")]) == cli.OK
    (tmp_path / "c.cpy").write_text("01 R.\n   05 A PIC X(3).\n")
    capsys.readouterr()
    assert cli.main(["schema", "from-copybook", str(tmp_path / "c.cpy")]) == cli.OK and json.loads(capsys.readouterr().out)["layout"][0]["name"] == "A"


def test_program_commands(capsys, tmp_path):
    (tmp_path / "p.cbl").write_text("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n       DATA DIVISION.\n       01 N PIC 9.\n       PROCEDURE DIVISION.\n       M.\n           MOVE 1 TO N.\n")
    assert cli.main(["convert", "--input", str(tmp_path / "p.cbl")]) == cli.OK
    assert json.loads(capsys.readouterr().out)["programs"] == ["P"]
    assert cli.main(["convert", "--input", str(tmp_path / "p.cbl"), "--out", str(tmp_path / "made")]) == cli.OK
    assert json.loads((tmp_path / "made" / "report.json").read_text())["status"] == "ok" and (tmp_path / "made" / "run.py").exists()
    (tmp_path / "q.cbl").write_text("       PROGRAM-ID. Q.\n           ACCEPT N.\n")
    assert cli.main(["check", "--input", str(tmp_path / "q.cbl")]) == cli.DATA
    assert cli.main(["check", "--input", str(tmp_path / "none.cbl")]) == cli.IO


@pytest.mark.parametrize("text", ["[", "{}", '{"files": [{"name": "A"}]}', '{"files": [{"name": "A", "record_length": 1, "encoding": "ebcdic"}]}', '{"files": [{"name": "A", "record_length": 1, "disposition": "x"}]}'])
def test_file_maps_that_cannot_be_used(text):
    with pytest.raises(binding.BindingError):
        binding.load(text)
    with pytest.raises(binding.BindingError):
        binding.named(["A"])
