"""The vectorised words and window hashes against regular expressions and plain sums."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import words as W

TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abZ09 \t\n\r\x0b\x0cé日-_.\x00\x7f")), max_size=40))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(texts, separators=W.SPACE, low=False):
    return W.split(*W.buffers(pa.array(texts, pa.string())), separators, low)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words(texts):
    for separators, low, pattern in ((W.SPACE, False, r"[^\x20\x09-\x0D]+"), (W.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = split(texts, separators, low)
        got = [[w.bytes_of(i).decode() for i in range(w.doc[k], w.doc[k + 1])] for k in range(len(texts))]
        want = [re.findall(pattern, lower(t) if low else t or "") for t in texts]
        assert got == want
        flat = [x for t in want for x in t]
        assert len(set(zip(flat, w.values().tolist()))) == len(set(flat)) == len(set(w.values().tolist()))
        n = np.arange(len(flat))
        for turn in range(len(flat)):
            assert w.equal(n, w, np.roll(n, turn)).tolist() == [a == b for a, b in zip(flat, np.roll(np.array(flat, object), turn))]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, W.PRIME - 1), max_size=40), st.integers(1, 14), st.integers(1, W.PRIME - 1))
def test_rolling(values, k, base):
    want = [sum(values[i + j] * pow(base, k - 1 - j, W.PRIME) for j in range(k)) % W.PRIME for i in range(len(values) - k + 1)]
    assert W.rolling(np.array(values, np.uint64), k, base).tolist() == want


def test_values_are_polynomials():
    words = ["a", "abcdefg", "abcdefgh", "é" * 40, "x" * 224, "y" * 225, "z" * 3000, "\x01" * 7, "\x01" * 8]
    base, w = W.new_key().word[0], split([" ".join(words), *words])
    for i, word in enumerate(words):
        raw, value = word.encode(), 0
        for at in range(0, len(raw), 7):
            value = (value * base + int.from_bytes(raw[at : at + 7], "little")) % W.PRIME
        want = value + (len(raw) << 56) if len(raw) <= 7 else (value * base + len(raw)) % W.PRIME
        assert w.values(base)[i] == w.values(base)[len(words) + i] == want


def test_windows_have_no_made_collision():
    """A Thue-Morse word and its complement have one value in every polynomial modulo 2^64, as have windows made of them."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    w = split([one, other, " ".join(one), " ".join(other)])
    for key in (W.FIXED, W.new_key()):
        values = w.values(key.word[0])
        assert values[0] != values[1]
        h, extra = W.wide_windows(w, 1024, key)
        assert h[2] != h[1026] and extra[2] != extra[1026] and W.windows(w, 1024, key)[2] != W.windows(w, 1024, key)[1026]


def test_chunks_cover_all_texts_once():
    offsets = np.array([0, 5, 5, 300, 301, 900])
    assert [(a, b) for a, b in W.chunks(offsets, 100)] == [(0, 2), (2, 3), (3, 4), (4, 5)]
