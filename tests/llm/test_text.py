from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm.text import slices, word_hashes

alphabet = st.text(alphabet="aAbé .,#\n\t\U0001f600ß", max_size=40)


def words(text, marks):
    if marks:
        return [w for token in re.split(r"[ \t\n]+", text) for w in re.findall(r"[^.,#]+|[.,#]+", token)]
    return [w for w in (re.sub(r"[.,#]", "", token) for token in re.split(r"[ \t\n]+", text.lower())) if w]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), alphabet), max_size=8), st.booleans())
def test_hashes_stand_for_words(texts, marks):
    hashes, offsets = word_hashes(pa.array(texts, pa.string()), marks)
    names = {}
    for i, text in enumerate(texts):
        own = hashes[offsets[i] : offsets[i + 1]].tolist()
        want = words(text or "", marks)
        assert len(own) == len(want)
        for h, w in zip(own, want):
            assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names), "equal words have equal hashes"


def test_slices_of_arrays_with_an_offset():
    texts = pa.array(["one two", "three", None, "one"]).slice(1)
    hashes, offsets = word_hashes(texts)
    assert offsets.tolist() == [0, 1, 1, 2] and hashes[1] == word_hashes(pa.array(["one"]))[0][0]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], names=["text"])
    parts = list(slices(batch, "text", 20))
    assert [p.num_rows for p in parts] == [2, 1, 1]
    assert list(slices(batch.slice(0, 0), "text")) == []
