import numpy as np
import pyarrow as pa

from tidemark.llm import words as W

TEXTS = ["The quick, brown fox. The end", None, "", "é à B2B\nx", "one", "aa", "bb", "…—“q”", "日本語 テスト。次"]


def plain(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def test_words_end_with_their_document():
    w = W.words(pa.array(TEXTS))
    data, _ = W.raw(pa.compute.utf8_lower(pa.array(TEXTS)))
    found = [[bytes(data[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    assert found == [plain(t) for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    a, b = W.words(pa.array(["x the quick", "quick"])), W.words(pa.array(["The", "QUICK the"]))
    assert a.hash[2] == a.hash[3] == b.hash[1] and a.hash[1] == b.hash[0] == b.hash[2]
    assert len(np.unique(W.words(pa.array([" ".join(map(str, range(5000)))])).hash)) == 5000


def test_shingles():
    s, o = W.shingles(W.words(pa.array(["a b c d e f", "a b c d e", "a b", "b a", "", None])))
    assert list(np.diff(o)) == [2, 1, 1, 1, 0, 0]
    assert s[0] == s[2] and s[3] != s[4]


def test_slices_of_columns():
    col = pa.array(TEXTS).slice(3, 3)
    assert len(W.words(col).hash) == 6 and W.raw(col)[1][-1] == len("é à B2B\nxoneaa".encode())
    assert list(W.text_parts(pa.array(["abcd"] * 10), 8)) == [(i, i + 2) for i in range(0, 10, 2)]
