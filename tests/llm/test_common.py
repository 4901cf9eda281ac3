import pyarrow as pa

from docmill.llm.common import Recent, pieces


def test_recent_keeps_what_is_used():
    made = []
    table = Recent(3, lambda k: made.append(k) or k * 2)
    for k in (1, 2, 1, 3, 1, 4, 1, 5, 1, 6, 1, 7, 1):
        assert table[k] == k * 2
    assert made == [1, 2, 3, 4, 5, 6, 7] and len(table) <= 3
    other = Recent(2)
    assert other.missing({1, 2}) == {1, 2}
    other.update({1: "a", 2: "b"})
    assert other.missing({1, 3}) == {3} and other[1] == "a"


def test_pieces_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, "b" * 50, None, "", "c" * 5]})
    got = list(pieces([batch], limit=20))
    assert [p.num_rows for p in got] == [1, 1, 3]
    assert list(pieces([batch.slice(0, 0)])) == []
