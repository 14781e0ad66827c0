"""Growing documents and the command line."""

import io
import json
import sys

import pytest

from quillgrid import __main__ as cli
from quillgrid import queries
from quillgrid.operators.compare import compare
from quillgrid.streaming.session import ReadAfterEnd, Session

TEXT = "# Order 7\n\nTotal: 1.50"


def test_a_session_ends_as_the_whole_text():
    for size in range(1, 10):
        one = Session(queries.CARD_SCHEMA)
        for upto in range(size, len(TEXT), size):
            assert one.read(TEXT[:upto]).validate().is_valid
        one.read(TEXT, end=True).validate()
        assert (one.value, one.errors) == (compare(queries.CARD_SCHEMA, TEXT).value, []) and one.json == '{"order":"7","total":"1.50"}'


def test_a_session_keeps_the_longest_text_and_its_end():
    one = Session("a").read("xb")
    assert one.read("x").text == "xb" and not one.validate().is_valid
    assert Session.of("a", "b").report().startswith("1:1: ")
    with pytest.raises(ReadAfterEnd):
        one.read("abc", end=True).read("abcd")


class Pipe(io.RawIOBase):
    """One byte at a time, and how many were read."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, size=-1):
        self.at += 1
        return self.data[self.at - 1 : self.at]


def test_judge_reads_bytes_and_stops_early():
    assert cli.judge("# é `n`", Pipe("# é ü".encode()), 1, True).value == {"n": "ü"}
    pipe = Pipe(b"# Land of plenty\n\n" + b"word " * 50)
    assert not cli.judge("# Nation `n`\n\n`body`", pipe, 1, True).is_valid and pipe.at < 20
    assert len(cli.judge("- `a:/x/`{1,2}", Pipe(b"- x\n- x\n- x"), 1, False).errors) == 1


def test_command_line(tmp_path, capsys, monkeypatch):
    schema, good, bad = (tmp_path / n for n in ("s.md", "good.md", "bad.md"))
    schema.write_text(queries.CARD_SCHEMA)
    good.write_text(TEXT)
    bad.write_text("# Order x")
    assert cli.main([str(schema), str(good)]) == 0
    assert json.loads(capsys.readouterr().out) == {"order": "7", "total": "1.50"}
    assert cli.main([str(schema), str(good), str(tmp_path / "out.json")]) == 0 and (tmp_path / "out.json").read_text() == '{"order":"7","total":"1.50"}\n'
    assert cli.main([str(schema), str(good), "--quiet"]) == 0 and capsys.readouterr().out == ""
    assert cli.main([str(schema), str(bad), str(tmp_path / "none.json")]) == 1 and not (tmp_path / "none.json").exists()
    assert "1:" in capsys.readouterr().err
    assert cli.main([str(schema), str(bad), "--raw-errors"]) == 1 and json.loads(capsys.readouterr().err.splitlines()[0])["category"] == "SchemaViolation"
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(TEXT.encode())))
    assert cli.main([str(schema), "-"]) == 0


def test_command_line_of_a_folder(spark, tmp_path):
    schema, folder = tmp_path / "s.md", tmp_path / "in"
    folder.mkdir()
    schema.write_text(queries.CARD_SCHEMA)
    (folder / "a.md").write_text(TEXT)
    assert cli.main([str(schema), str(folder), str(tmp_path / "out")]) == 0
    (folder / "b.md").write_text("nothing")
    assert cli.main([str(schema), str(folder), "--quiet"]) == 1
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"order":"7","total":"1.50"}']
