import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import common

from .test_repetition import morse


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_segments_are_equal_where_their_bytes_are(raw):
    data = np.frombuffer(raw, np.uint8)
    hashes = common.Rolling(common.byte_values()[data])
    at = [(i, j) for i in range(len(raw)) for j in range(i + 1, len(raw) + 1)]
    if not at:
        return
    a, b = np.array(at).T
    found, seen = {}, {}
    for (i, j), h in zip(at, hashes.segment(a, b).tolist(), strict=True):
        assert found.setdefault(raw[i:j], h) == h
        assert seen.setdefault(h, raw[i:j]) == raw[i:j]
    for k in (1, 3, 4, 9):
        assert hashes.windows(k).tolist() == [found[raw[i : i + k]] for i in range(len(raw) - k + 1)]


def test_regular_texts_have_hashes_of_their_own():
    for size in (64, 1024, 1 << 16):
        data = [np.frombuffer(t.encode(), np.uint8) for t in morse(size)]
        whole = [common.Rolling(common.byte_values()[d]).segment(np.array([0]), np.array([size]))[0] for d in data]
        words = [common.Rolling(common.mix(d.astype(np.uint64))).segment(np.array([0]), np.array([size]))[0] for d in data]
        assert whole[0] != whole[1] and words[0] != words[1]


def test_word_keys():
    texts = ["a  b", "a b ", "ab", "", "a b", "é\nb"]
    data, bounds = common.text_bytes(__import__("pyarrow").array(texts))
    keys = [tuple(k) for k in common.word_keys(data, bounds, *common.words_of(data, bounds)).tolist()]
    assert keys[0] == keys[1] == keys[4] and len(set(keys)) == 4
