import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trajlake.llm._text import pieces, short_hash, utf8, windows, word_hashes, words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0bé本", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words_equal_bytes_split(rows):
    data, offsets = utf8(pa.array(rows, pa.string()))
    starts, ends, at = words(data, offsets)
    raw = data.tobytes()
    found = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)]
    assert found == [(r or "").encode().split() for r in rows]


@settings(max_examples=50, deadline=None)
@given(texts)
def test_equal_windows_have_equal_hashes(rows):
    data, offsets = utf8(pa.array(rows, pa.string()))
    starts, ends, at = words(data, offsets)
    begin, hashes = windows(word_hashes(data, starts, ends, 11)[0], at, 2, 1)
    raw = data.tobytes()
    names = [(raw[starts[b] : ends[b]], raw[starts[b + 1] : ends[b + 1]]) for b in begin]
    assert len(set(names)) == len(set(hashes.tolist())) == len(set(zip(names, hashes.tolist(), strict=True)))
    assert len(begin) == sum(max(0, n - 1) for n in np.diff(at))


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_patterns_that_cancel_in_polynomials_do_not_collide():
    pair = ["".join("ab"[b ^ flip] for b in thue_morse(1024)) for flip in (0, 1)]
    data, offsets = utf8(pa.array([*pair, "ab", "ba", "a", "a\0"]))
    for hashes in word_hashes(data, offsets[:-1], offsets[1:], 11, 12):
        assert len(set(hashes.tolist())) == 6
    values = np.array([[3, 5][b ^ flip] for flip in (0, 1) for b in thue_morse(2048)], np.uint64)
    begin, hashes = windows(values, np.array([0, 2048, 4096]), 2048, 1)
    assert begin.tolist() == [0, 2048] and hashes[0] != hashes[1]


def test_windows_of_any_length():
    values = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 35, 64, 100):
        begin, hashes = windows(values, np.array([0, 150, 150, 400]), k, 1)
        assert begin.tolist() == [i for a, b in ((0, 150), (150, 400)) for i in range(a, b - k + 1)]
        names = [tuple(values[i : i + k].tolist()) for i in begin]
        assert len(set(names)) == len(set(hashes.tolist())) == len(set(zip(names, hashes.tolist(), strict=True)))
    short = short_hash(values, np.array([0, 1, 1, 7]), np.array([2, 2, 4, 7]), 1)
    assert len(set(short.tolist())) == 4


def test_pieces_cover_all_rows_once():
    rows = ["a" * n for n in (5, 0, 3, 50, 1, 1)] + [None]
    column = pa.array(["x", *rows], pa.string()).slice(1)
    got = [(lo, hi, data.tobytes()) for lo, hi, data, _ in pieces(column, 8)]
    assert [x[0] for x in got] == [0, *[x[1] for x in got[:-1]]] and got[-1][1] == len(rows)
    assert b"".join(x[2] for x in got) == b"a" * 60
