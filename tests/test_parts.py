"""Python steps take Arrow batches in slices, and keep nothing beyond what they give."""

import pyarrow as pa

from inkspark.operators import copies
from inkspark.sources import tables


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 10)
    monkeypatch.setattr(tables, "PART_ROWS", 3)
    texts = ["aaaa", "bbbbbb", None, "c" * 25, "", "", "", "d", "e"]
    for kind in (pa.string(), pa.binary()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string()).cast(kind)], ["n", "text"])
        got = list(tables.parts([batch.slice(0, 0), batch, batch.slice(7)], "text"))
        assert [x.num_rows for x in got] == [3, 1, 3, 2, 2]
        assert [v for x in got for v in x.column("n").to_pylist()] == [*range(9), 7, 8]
    batch = pa.RecordBatch.from_arrays([pa.array([[1], [2], [], [4]])], ["l"])
    assert [x.num_rows for x in tables.parts([batch], "l")] == [3, 1]


def test_marks_keep_no_more_than_their_hashes():
    text = "".join(chr(97 + i * i % 26) for i in range(5000))
    for is_probe, h in copies.marks(text):
        assert is_probe or (h.base is None and len(h) == -(-(5000 - 59) // 20))
