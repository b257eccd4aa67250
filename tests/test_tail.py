"""Ends of files: whole lines within a number of bytes, and a marker for each file."""

import json
import tempfile

import pytest

from tessera.sources import tail, transcripts


def folder_of(**files):
    folder = tempfile.mkdtemp(prefix="spark-tails-")
    for name, data in files.items():
        with open(f"{folder}/{name}.jsonl", "wb") as f:
            f.write(data)
    return folder


def expected(data: bytes, most: int):
    """Lines that begin within the last bytes, one after another."""
    out, at = [], 0
    for line in data.split(b"\n"):
        if at >= len(data) - most and line.strip():
            out.append((at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("most", [1, 2, 6, 7, 8, 30, 10**6])
def test_lines_that_begin_within_the_tail(most):
    data = "alpha\nbêta\n\n  \ngamma δ\nlast".encode()
    folder = folder_of(a=data)
    reader = tail.TailReader({"path": folder, "most": str(most)})
    (part,) = reader.partitions()
    assert part.stop - part.start <= most
    assert [(o, v) for _, o, v in reader.read(part)] == expected(data, most)


def test_long_and_empty_files(spark):
    folder = folder_of(empty=b"", blank=b"\n\n", long=b"x" * 5000 + b"\nend\n", one=b"y" * 5000)
    assert [(r.file.rsplit("/", 1)[1], r.value) for r in tail.line_tails(spark, folder, 100).collect()] == [("long.jsonl", "end")]
    assert tail.line_tails(spark, folder_of(), 100).count() == 0
    with pytest.raises(ValueError):
        tail.TailReader({"path": folder, "most": "0"})


def test_each_file_has_its_own_marker(spark):
    def line(kind, minute, content):
        return json.dumps({"type": kind, "timestamp": f"2024-01-01T10:{minute:02d}:00Z", "message": {"content": content}})

    mark = f"This session is {transcripts.CONTINUED}"
    a = [line("user", 1, mark), line("user", 2, "a-two"), line("user", 5, [{"type": "text", "text": mark}]), line("assistant", 6, "a-six"), "{broken"]
    b = [line("user", 1, "b-one"), line("assistant", 3, mark), line("user", 4, "b-four")]
    c = [line("user", 1, "c-one"), line("user", 9, mark)]
    folder = folder_of(**{n: "\n".join(x).encode() for n, x in zip("abc", (a, b, c))})
    got = {(r.file.rsplit("/", 1)[1][0], r.texts[0]) for r in transcripts.read_tails(spark, folder).collect()}
    assert got == {("a", "a-six"), ("b", "b-one"), ("b", mark), ("b", "b-four")}
    short = transcripts.read_tails(spark, folder, len(b[-1]))
    assert {r.texts[0] for r in short.collect() if "/b." in r.file} == {"b-four"}
