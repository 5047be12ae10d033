"""Workers that stay for later stages give free memory back after each batch."""

import pyarrow as pa

from inkspark.llm import arrays


def test_memory_goes_back_once_a_batch(monkeypatch):
    given = []
    monkeypatch.setattr(arrays, "give_back", lambda: given.append(1))
    assert [at for at, _ in arrays.slices(pa.array(["a" * 50, None, "b" * 60, "c"]), 100)] == [0, 2]
    assert len(given) == 1
    monkeypatch.undo()
    arrays.give_back()
