import re

import numpy as np
import pyarrow as pa

from lectern.llm.common import Words, run_hashes, sequence_hashes, slices, span_hashes

TEXTS = ["", None, "one", " two  words\n", "a b\tc\x0bd e", "é ß x  日本 語", "\n\n", "x" * 5000 + " y"]


def test_words_follow_the_pattern():
    w = Words(pa.array(TEXTS))
    data = w.data.tobytes()
    got = [[data[w.start[i] : w.end[i]].decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(TEXTS))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_words_of_a_slice_and_of_no_text():
    a = pa.array(TEXTS)
    assert len(Words(a[0:2]).start) == 0
    assert len(Words(a[3:5]).start) == 7
    assert len(Words(pa.array([], pa.string())).start) == 0


def test_hashes_do_not_depend_on_the_place():
    h = Words(pa.array(["foo bar foo", "bar", "foo bar"])).hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[3] == h[5] and h[0] != h[1]


def test_sequence_hashes():
    w = Words(pa.array(["a b c d a b c", "a b c"]))
    h = w.hashes()
    s = sequence_hashes(h, np.array([0, 4, 7, 0]), np.array([3, 3, 3, 2]))
    assert s[0] == s[1] == s[2] != s[3]
    g = run_hashes(h, 3)
    assert len(g) == 8 and g[0] == g[4] == g[7] != g[1]


def test_slices_cover_all_rows():
    a = pa.array(["x" * n for n in (5, 0, 100, 1, 1)])
    assert list(slices(a, 10)) == [(0, 2), (2, 3), (3, 5)]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_hashes_tell_thue_morse_strings_apart():
    for n in (64, 512, 1024, 2048, 4096, 1 << 15):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        w = Words(pa.array([f"{a} {b} {a}", " ".join(a) + " " + " ".join(b)]))
        h = w.hashes()
        assert h[0] == h[2] != h[1]
        s = sequence_hashes(h, np.array([3, 3 + n]), np.array([n, n]))
        assert s[0] != s[1]


def test_span_hashes_of_all_lengths():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    raw = data.tobytes()
    start = rng.integers(0, 2000, 3000)
    end = start + rng.choice([0, 1, 2, 7, 8, 9, 63, 64, 65, 128, 513, 1900], 3000)
    h = span_hashes(data, start, end)
    by = {}
    for x, i, j in zip(h.tolist(), start.tolist(), end.tolist()):
        assert by.setdefault(raw[i:j], x) == x
    assert len(set(by.values())) == len(by)


def test_numbers_follow_the_bytes():
    w = Words(pa.array(TEXTS + TEXTS))
    raw = w.data.tobytes()
    words = [raw[i:j] for i, j in zip(w.start, w.end)]
    n = w.numbers().tolist()
    assert len(set(zip(words, n))) == len(set(words)) == len(set(n))
    assert len(Words(pa.array([], pa.string())).numbers()) == 0
