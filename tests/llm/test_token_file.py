import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmill.llm import token_file as t
from docmill.llm.bpe import vocabulary
from docmill.llm.token_file import encoder, pack, seal, token_files, unpack, unseal

PATH = vocabulary("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50257), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 9))
def test_words_round_trip(ids, times):
    ids = np.array(ids * times, np.uint64)
    words, offsets = pack(ids)
    assert (unpack(words, offsets, len(ids)) == ids).all()


def test_runs_of_small_ids_share_words():
    words, _ = pack(np.zeros(600, np.uint64))
    assert len(words) == 10


def test_segment():
    ids, lengths = unseal(seal(np.arange(5000), [0, 4000, 1000]))
    assert ids.tolist() == list(range(5000)) and lengths.tolist() == [0, 4000, 1000]
    assert unseal(seal(np.arange(0), []))[0].tolist() == []
    with pytest.raises(ValueError):
        unseal(b"nope" + bytes(30))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_same_ids_as_library(text):
    assert np.frombuffer(encoder(PATH).encode([text])[0], "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "a \n b", "x <|endoftext|> y", "a\0 b c", "I'm ' s", "é ü", "a\x1c b", "　 a　b"])
def test_hard_texts(text):
    assert np.frombuffer(encoder(PATH).encode([text])[0], "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_files(spark):
    rows = [(5, "b c", 1), (-1, None, 1), (3, "long " * 3000, 1), (9, "", 1), (3, "long " * 3000, 1)]
    got = token_files(spark.createDataFrame(rows, "doc_id long, text string, start int"), PATH).collect()
    got.sort(key=lambda r: r.start)
    at = 0
    for r, (doc, text, _) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = LIB.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ranges_grow_with_the_input(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * 50) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = sorted(tuple(r) for r in t.token_files(docs, vocabulary("byte_bpe_50k.json")).collect())
    monkeypatch.setattr(t, "RANGE_BYTES", 500)
    monkeypatch.setattr(t, "SEGMENTS_SENT", 1)
    segments = t.write(docs, vocabulary("byte_bpe_50k.json"))
    assert segments.select("part").distinct().count() > 5
    assert sorted(tuple(r) for r in t.read(segments).collect()) == want
