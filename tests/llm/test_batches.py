import pyarrow as pa

from tidemark.llm.batches import parts


def test_parts_are_bounded_and_whole():
    texts = ["a" * 30, None, "", "b" * 500, "c" * 40, "d" * 60, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = [p.column(1).to_pylist() for p in parts(batch, 1, rows=3, chars=100)]
    assert [t for p in got for t in p] == texts and all(len(p) <= 3 for p in got)
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 100 for p in got)
    assert list(parts(batch.slice(0, 0), 1)) == []
