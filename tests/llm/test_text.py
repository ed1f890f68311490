import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomquery.llm._text import ALNUM, SPACED, Known, buffers, chunks, distinct, grouped, split_words, sums
from tests.llm.samples import words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0b é中1-", max_size=12)), max_size=8), st.integers(0, 3))
def test_words_match_plain_splitting(values, skip):
    column = pa.array(["skipped"] * skip + values, pa.string()).slice(skip)
    data, offsets, valid = buffers(column)
    assert valid.tolist() == [v is not None for v in values]
    for i, j in chunks(offsets, 7):
        found = split_words(data, offsets[i : j + 1], SPACED)
        got = [[found.word(k) for k in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        assert got == [words(v) for v in values[i:j]]
        seen = {}
        for k, h in enumerate(found.hashes().tolist()):
            assert seen.setdefault(h, found.word(k)) == found.word(k)


def test_alnum_words_and_sums():
    data, offsets, _ = buffers(pa.array(["Ab-c9 é!", "", "Z"]))
    found = split_words(data, offsets, ALNUM)
    assert [found.word(k) for k in range(len(found.start))] == [b"ab", b"c9", "é".encode(), b"z"]
    assert sums(np.ones(4, np.int64), found.first).tolist() == [3, 0, 1]


def test_equal_words_have_equal_hashes_in_any_chunk():
    one = split_words(*buffers(pa.array(["abc"]))[:2], SPACED).hashes()
    many = split_words(*buffers(pa.array(["x" * 5000 + " y abc"]))[:2], SPACED).hashes()
    assert one[0] == many[2]


def thue_morse(n: int, a: str, b: str) -> tuple[str, str]:
    """Two different words that any polynomial modulo 2^64 gives one hash."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_different_words_have_different_keys():
    x, y = thue_morse(2048, "a", "b")
    values = [x, y, "a" * 15, "a" * 16, "a" * 15 + "\x00", "a", "a\x00", "\x00", "a" * 7, "a" * 8, "a" * 9, "a" * 8 + "\x00"]
    found = split_words(*buffers(pa.array(values))[:2], SPACED)
    assert len(set(zip(*(k.tolist() for k in found.keys()), strict=True))) == len(values)
    assert len(set(found.hashes().tolist())) == len(values)


def test_equal_halves_of_different_values():
    first, second = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    assert [v.tolist() for v in distinct(first, second)] == [[5, 5, 7], [1, 2, 1]]
    at, own = grouped(first, second)
    assert sorted(at.tolist()) == [0, 1, 3] and own[0] == own[2] and own[1] == own[4] and len(set(own.tolist())) == 3
    known = Known()
    known.add(first[at], second[at], at)
    assert known.find(first, second).tolist() == [0, 1, 0, 3, 1] and known.find(second, first).tolist() == [-1] * 5
