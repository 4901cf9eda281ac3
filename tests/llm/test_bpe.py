import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmill.llm.bpe import bpe, round_trip, vocabulary

PATH = vocabulary("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def ids(text):
    raw = bpe(PATH).encode([text])[0]
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


@pytest.mark.parametrize("text", ["", " ", "aaaaaaaaa aaa", "It's we'LL 12 ²", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ", "İstanbul été", "x\x1cy\x1f \x85z　w", "naïve\tçà\n\nß", "!!'s''t", "日本語 123 🎉🎉", "̀a", "a " * 5000])
def test_same_ids_as_library(text):
    assert ids(text) == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    raw = bpe(PATH).encode([text])[0]
    assert bpe(PATH).decode(raw) == LIB.decode(want, skip_special_tokens=False)


def test_frame(spark):
    rows = [(1, "The cat's hat", 5), (2, None, 5), (None, "", 5), (1, "The cat's hat", 5)]
    got = round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert [r.n_tokens for r in got] == [len(ids(t or "")) for _, t, _ in rows]
    assert got[1].ids_sha256 == got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_every_code_point():
    """Characters of every plane, between letters and between signs; unassigned ones, too."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 11 == 0 or 0xE0000 <= c < 0xE0200)]
    for start in range(0, len(points), 20000):
        made = [f"ab{chr(c)}cd !{chr(c)}.1{chr(c)}" for c in points[start : start + 20000]]
        for text, raw, want in zip(made, bpe(PATH).encode(made), LIB.encode_batch(made, add_special_tokens=False), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == want.ids, ascii(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="aé'ÖΣİß.1 ", max_size=8), st.text(max_size=4)), max_size=8))
def test_pieces_of_all_planes(parts):
    text = "".join(parts)
    assert ids(text) == LIB.encode(text, add_special_tokens=False).ids
