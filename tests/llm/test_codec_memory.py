"""Texts of a batch are read and coded by parts."""

import pyarrow as pa

from pixelweave.llm import piece_codec as pc


def test_a_batch_is_coded_in_parts_and_every_row_comes_back(monkeypatch):
    texts = ["one two", None, "", "three " * 40, "four", "x" * 500, "one two"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "c0"])
    whole = [r for b in pc._coded(iter([batch]), pc.default_model(), True) for r in b.to_pylist()]
    monkeypatch.setattr(pc, "TOGETHER", 100)
    monkeypatch.setattr(pc, "WORDS_TOGETHER", 2)
    parts = list(pc._coded(iter([batch, batch.slice(0, 0)]), pc.default_model(), True))
    assert [r for b in parts for r in b.to_pylist()] == whole and [r["c0"] for r in whole] == list(range(len(texts)))
    assert len(parts) >= 4 and all(p.num_rows for p in parts)
