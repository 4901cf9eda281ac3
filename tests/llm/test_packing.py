import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmill.llm import packing
from docmill.llm.bpe import vocabulary

PATH = vocabulary("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def gapless(rows, capacity):
    """``(sequence, offset, length)`` of whole sequences; their number."""
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    return len(by)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_is_the_best_of_all(counts, room):
    own = sorted(counts.items(), reverse=True)
    got = packing.fullest(own, room)
    assert all(n <= counts[x] for x, n in got)
    best = max(t for t in (sum(x * n for (x, _), n in zip(own, many, strict=True)) for many in product(*(range(n + 1) for _, n in own))) if t <= room)
    assert sum(x * n for x, n in got) == best


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40)))
def test_patterns_use_every_piece_once(counts):
    plan = packing.patterns(counts, 20)
    used = Counter()
    for often, own in plan:
        assert often > 0 and sum(x * n for x, n in own) <= 20
        for x, n in own:
            used[x] += often * n
    assert used == Counter(counts)
    # one sequence at a time gives the same number of them
    left, alone = dict(sorted(counts.items(), reverse=True)), 0
    while left:
        for x, n in packing.patterns(left, 20)[0][1]:
            left[x] -= n
        left, alone = {x: n for x, n in left.items() if n}, alone + 1
    assert alone == sum(often for often, _ in plan)


def test_few_sequences_on_many_lengths():
    r = np.random.default_rng(1)
    lengths = np.minimum(4096, r.lognormal(5.5, 1.2, 20000).astype(int) + 1)
    plan = packing.patterns(Counter(lengths.tolist()), 4096)
    assert sum(often for often, _ in plan) <= -(-int(lengths.sum()) // 4096) + 1


def test_any_frame_of_lengths(spark):
    r = np.random.default_rng(2)
    rows = [(int(x), f"n{i}", None) for i, x in enumerate([*r.integers(1, 50, 400), *[64] * 200, *[1] * 100])]
    df = spark.createDataFrame(rows, "length long, _part_name string, nothing int").repartition(5)
    got = packing.pack(df, 64).collect()
    assert sorted((x.length, x._part_name) for x in got) == sorted((n, i) for n, i, _ in rows)
    assert gapless([(x.sequence_id, x.offset, x.length) for x in got], 64) <= -(-sum(n for n, _, _ in rows) // 64) + 1
    assert packing.pack(df.limit(0), 64).collect() == []
    for bad in (0, 65):
        with pytest.raises(ValueError, match="from 1 to 64"):
            packing.pack(spark.createDataFrame([(bad,), (3,)], "length long"), 64)


def test_documents(spark):
    rows = [(1, "the cat sat " * 40), (2, None), (3, ""), (None, "one"), (4, "a b c"), (4, "a b c"), (5, "x<|endoftext|>y " * 30), *[(10 + i, "word " * i) for i in range(40)]]
    df = spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "doc_id long, text string, piece int, length int").repartition(4)
    got = packing.packed(df, PATH, 32).collect()
    want = []
    for i, t in rows:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 32)):
            want.append((i, n, at, len(ids[at : at + 32]), zlib.crc32(np.array(ids[at : at + 32], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    used = gapless([(r.sequence_id, r.offset, r.length) for r in got], 32)
    assert used <= -(-sum(r.length for r in got) // 32) + 1
    assert packing.packed(df.limit(0), PATH).collect() == []


def test_query(spark):
    got = packing.op12_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ids = {d.doc_id: [*LIB.encode(d.text or "", add_special_tokens=False).ids, 1] for d in docs}
    assert sorted((r.doc_id, r.piece) for r in got) == sorted((d, n) for d, own in ids.items() for n in range(-(-len(own) // 4096)))
    for r in got:
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(cut) == r.length and r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
    assert gapless([(r.sequence_id, r.offset, r.length) for r in got], 4096) <= -(-sum(r.length for r in got) // 4096) + 1
