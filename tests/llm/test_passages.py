import random
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import passages, substrings
from tidemark.llm.queries import QUERIES
from tidemark.llm.words import words


def shared_by_hand(texts, size):
    """Words in windows of `size` words that another row has as well."""
    listed = [words(pa.array([t or ""])).hash.tolist() for t in texts]
    have = Counter(w for x in listed for w in {tuple(x[k : k + size]) for k in range(len(x) - size + 1)})
    return [len({k + j for k in range(len(x) - size + 1) if have[tuple(x[k : k + size])] > 1 for j in range(size)}) for x in listed]


def prose(rng, n, least=2):
    return " ".join("".join(rng.choice("aeinorstlé") for _ in range(rng.randint(least, 9))) for _ in range(n))


def test_query_tells_passages_of_over_50_words_of_fewer_bytes_than_it_removes(spark, tmp_path):
    rng = random.Random(21)
    passage = " ".join(rng.choice("the of and to in is on by for with".split()) + str(k) for k in range(51))
    other = " ".join(passage.split()[:50])
    texts = [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(6)] + [f"{prose(rng, 40)} {other} {prose(rng, 30)}" for _ in range(6)] + [prose(rng, 120) for _ in range(6)]
    assert len(passage) < 400
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_longest_factors"](spark, str(tmp_path)).collect()}
    assert [got[i].n_passage_words for i in range(18)] == [51] * 6 + [0] * 12
    assert not any(r.n_removed for r in got.values())  # by contract: under 400 bytes


@pytest.mark.parametrize("size", [6, 12])
def test_shared_words_equal_brute_force(spark, size):
    rng = random.Random(22)
    few = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    common = [prose(rng, n) for n in (size - 1, size, size + 1, 3 * size, 60)]
    texts = [f"{prose(rng, rng.randint(0, 30))} {rng.choice(common)} {prose(rng, rng.randint(0, 30))}" for _ in range(40)] + [few(60) for _ in range(12)]
    texts += ["the " * 40, "the " * 90, "so " + "the " * 30, None, "", "a", common[3], common[3], "ab " * 50 + common[4].upper(), f"{prose(rng, 14)} {prose(rng, 14)} " * 2]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS t1", "3 AS many", "4 AS n_shared")
    got = {r.doc_id: r.n_shared for r in substrings.remove_repeats(df, passage_words=size).collect()}
    want = shared_by_hand(texts, size)
    assert [got[i] for i in range(len(texts))] == want and 0 in want and len({*want}) > 5


def test_repeated_and_missing_ids(spark):
    rng = random.Random(23)
    common = prose(rng, 55)
    rows = [(1, common), (1, common), (None, f"{common} x"), (1, f"y {common}"), (None, prose(rng, 80)), (None, None), (2, f"{common} z {common}")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=51).collect()
    assert Counter((r.doc_id, r.n_shared) for r in got) == Counter([(1, 55), (1, 55), (None, 55), (1, 55), (None, 0), (None, 0), (2, 110)])


def test_words_of_a_long_text_are_hashed_in_pieces(monkeypatch):
    column = pa.array(["ab cd\tÉf " * 9000 + "g" * 9000 + " h"])
    whole = words(column).hash
    monkeypatch.setattr(passages, "PIECE", 1000)
    h, offsets = passages.word_hashes(column)
    assert h.tolist() == whole.tolist() and offsets.tolist() == [0, len(whole)]
