import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from isovox.llm import _text

from tests.llm.conftest import words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB é\t\n\x0b\x1f 日 ."), max_size=30)), max_size=8))
def test_words(texts):
    column = pa.array(texts, pa.string())
    w = _text.words(column)
    raw = w.data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]
    h, flat = w.hashes(), [x for t in got for x in t]
    assert len(set(h.tolist())) == len(set(flat))
    assert len({(x, y) for x, y in zip(h.tolist(), flat)}) == len(set(flat))
    for k in (2, 3):
        at = _text.inside_doc(w.first, k)
        want = [tuple(t[i : i + k]) for t in got for i in range(len(t) - k + 1)]
        r = _text.runs(h, k)[at].tolist()
        assert len(r) == len(want) and len(set(zip(r, want))) == len(set(want)) == len(set(r))


def test_chunks():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aaaa", None, "b" * 50, "cc", "dd"], pa.string()), "n": [0, 1, 2, 3, 4]})
    parts = list(_text.chunks([batch, batch.slice(0, 0)], limit=6))
    assert [x for p in parts for x in p.column("n").to_pylist()] == [0, 1, 2, 3, 4] and len(parts) == 3
    sliced = batch.slice(2, 2)
    assert _text.views(sliced.column("text"))[0].tobytes() == b"b" * 50 + b"cc"
    assert np.array_equal(_text.views(sliced.column("text"))[1], [0, 50, 52])
