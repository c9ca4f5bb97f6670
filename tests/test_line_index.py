"""The line index: byte splits that cut lines, one scan, totals without a scan."""

import contextlib
import io
import os
import random

import pytest

from textlab.sources import files as IO
from textlab.sources import line_index as LI


def _put(folder, name, data: bytes) -> str:
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def _want(data: bytes) -> list[str]:
    return [x.decode("utf-8", "replace") for x in data.removeprefix(LI.BOM).splitlines()]


def test_splits_at_every_byte(tmp_path, monkeypatch):
    """Every split size and several chunk sizes: each line once, whole, in order; counts equal."""
    rng = random.Random(3)
    cases = [b"", b"\n", b"\r\n", b"\r", b"a", b"\r\r\n\n", b"ab\r\ncd\re\n\nf", b"x" * 40 + b"\n" + b"y"]
    cases += [bytes(rng.choice(b"ab\r\n") for _ in range(rng.randrange(30))) for _ in range(60)]
    for i, data in enumerate(cases):
        path, size = _put(str(tmp_path), f"f{i}", data), len(data)
        for chunk in (1, 2, 3, 7, 64):
            monkeypatch.setattr(LI, "CHUNK_BYTES", chunk)
            for step in (1, 2, 3, 5, 50):
                got, counts = [], 0
                for s in range(0, size, step):
                    e = min(s + step, size)
                    own = [x for part in LI.split_lines(path, size, s, e) for x in part]
                    n = LI.count_starts(path, size, s, e)
                    assert len(own) == n, (data, chunk, step, s)
                    got += own
                    counts += n
                assert got == data.splitlines() and counts == len(got), (data, chunk, step)


def test_same_rows_as_read_lines(spark, tmp_path):
    base = str(tmp_path / "lines")
    parts = [b"one \r\ntwo\rthree\n\n", b"", "vier  €\n fünf".encode(), b"six\n" * 50 + b"z" * 300 + b"\nend\n"]
    for i, data in enumerate(parts):
        _put(base, f"part-{i}", data)
    want = [(r.line_no, r.line) for r in IO.read_lines(spark, base).orderBy("line_no").collect()]
    for split_bytes in (7, 64, 1 << 20):
        index = LI.index_lines(spark, base, split_bytes=split_bytes)
        got = [(r.line_no, r.line) for r in LI.read_indexed(spark, index).orderBy("line_no").collect()]
        assert got == want and LI.count_indexed(spark, index) == len(want)


def test_marks_bad_bytes_empty_and_changed_files(spark, tmp_path):
    base = str(tmp_path)
    path = _put(base, "a.txt", LI.BOM + b"head\nbad \xff\xfe byte\n\nlast")
    index = LI.index_lines(spark, path, split_bytes=9)
    rows = LI.read_indexed(spark, index, strip=False).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["head", "bad �� byte", "", "last"]
    empty = LI.index_lines(spark, _put(base, "empty.txt", b""))
    assert LI.read_indexed(spark, empty).collect() == [] and LI.count_indexed(spark, empty) == 0
    _put(base, "a.txt", b"longer than before, so the index no longer holds\n")
    with pytest.raises(Exception, match="when it was indexed"):
        LI.read_indexed(spark, index).collect()


def test_one_scan_a_file_and_alignment(spark, tmp_path):
    base = str(tmp_path)
    text = {"orig": b"The cat sat .\nA dog ran .\n", "ref": b"A cat .\nA dog .\n", "r1": b"Cat .\nDog .\n", "short": b"Cat .\n"}
    index = {k: LI.index_lines(spark, _put(base, f"{k}/p.txt", v)) for k, v in text.items()}
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        LI.read_indexed(spark, index["orig"]).explain()
    assert buf.getvalue().count("Scan") == 1 and "Exchange" not in buf.getvalue()
    ev = LI.eval_indexed(spark, index["orig"], index["ref"], {"r1": index["r1"]})
    rows = [(r.pair_id, r.orig, r.ref, r.y0) for r in ev.rows.orderBy("pair_id").collect()]
    assert rows == [(0, "The cat sat .", "A cat .", "Cat ."), (1, "A dog ran .", "A dog .", "Dog .")]
    with pytest.raises(ValueError, match="not aligned"):
        LI.eval_indexed(spark, index["orig"], index["ref"], {"short": index["short"]})
