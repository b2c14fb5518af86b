import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidemark.llm import decontaminate as D
from tidemark.llm import language as L
from tidemark.llm import lines, mixing, quality, sstable, substrings, warc
from tidemark.llm import words as W
from tidemark.llm.encode import Encoder
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.store import Workspace
from tidemark.tables import table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


def removed_by_hand(texts, length, first_stays=False):
    seen, order = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
        order.append(b)
    out = []
    for i, b in enumerate(order):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            at = seen[b[k : k + length]]
            if (at[0] != (i, k)) if first_stays else len(at) > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("first_stays", [False, True])
@pytest.mark.parametrize("bucket_bytes", [0, 4000, 7 << 18])
def test_removed_strings_equal_brute_force(spark, first_stays, bucket_bytes):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    texts = [text(20) + rng.choice(shared) + text(rng.randint(0, 40)) for _ in range(25)] + ["and " * 120, "so " + "and " * 50, "x" * 64, "x" * 63, "x" * 200, None, "", text(5), shared[0], shared[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS t1", "3 AS many", "4 AS first")
    got = {r.doc_id: digested(r) for r in substrings.remove_repeats(df, length=64, first_stays=first_stays, bucket_bytes=bucket_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_hand(texts, 64, first_stays)


def digested(r):
    assert all(s.start < s.stop for s in r.spans) and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert r.n_bytes - len(r.kept) == sum(s.stop - s.start for s in r.spans)
    return r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()


def test_query_removes_passages_of_over_50_words(spark, tmp_path):
    """The registered query and its 400 bytes, against brute force: passages shared by documents, repeated ids, nulls and copies."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("aeinorstlé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [prose(n) for n in (51, 70, 90, 160)]
    texts = [prose(40) + " " + passages[i % 4] + " " + prose(30) for i in range(24)] + [prose(120) for _ in range(20)] + [None, "", "ab " * 300, prose(90)]
    texts += [texts[-1], passages[3]]
    rows = [*enumerate(texts)]
    rows[21] = (20, rows[21][1])  # an id with two texts
    rows[22] = (None, rows[22][1])
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS spans").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_longest_factors"](spark, str(tmp_path)).collect()), key=str)
    want = removed_by_hand([t for _, t in rows], 400)
    assert got == sorted(want, key=str)
    caught = [w[1] > 0 for w in want[:24]]
    assert all(c for c, (_, t) in zip(caught, rows, strict=False) if any(len(p.encode()) > 400 and p in t for p in passages)) and not any(w[1] for w in want[24:44])


def test_stretches_of_pieces_are_those_of_the_whole_text(monkeypatch):
    data = random.Random(13).choices(["ab ", "cde ", "f ", "ghij "], k=9000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["".join(data)])], names=["t1", "t2", "_t"])

    def starts():
        rows = [r for b in substrings._found(iter([batch]), 400) for r in b.to_pylist()]
        return sorted((r["lo"] + k, r["key"]) for r in rows for k in range(r["n"]))

    whole = starts()
    monkeypatch.setattr(substrings, "PIECE", 5000)
    assert starts() == whole and len(whole) == len("".join(data)) - 399


def test_removal_from_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_previous_smaller():
    x = np.random.default_rng(6).permutation(300)
    want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(300)]
    assert substrings.previous_smaller(x).tolist() == want


def test_suffix_ranks_are_in_byte_order():
    data = np.frombuffer(random.Random(7).choices(b"ab", k=900).__repr__().encode(), np.uint8)
    starts = np.arange(0, len(data) - 400)
    rank = substrings.suffix_ranks(data, starts, 400)
    strings = [data[i : i + 400].tobytes() for i in starts]
    names = sorted(set(strings))
    assert rank.argsort(kind="stable").tolist() == sorted(range(len(starts)), key=lambda i: (strings[i], i))
    assert len(set(rank.tolist())) == len(names)


def test_token_shards_round_trip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-5, None), (-4, ""), (-3, "  two  spaces \n"), (-2, "<|endoftext|> a"), (None, "no key"), (None, None), (0, "again"), (0, "again"), (9, "long " * 60_000)], "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 AS id", "2 AS h", "3 AS place", "4 AS start")
    ws = Workspace(spark, "t")
    path = sstable.byte_bpe_path()
    manifest = ws.keep(sstable.write_shards(docs, ws.path("s"), path, shard_bytes=20_000), "m")
    got = sorted((tuple(r) for r in sstable.read_shards(spark, manifest).collect()), key=lambda r: r[1])
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(path), 0, []
    ids = {}
    h = F.xxhash64("text")
    for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), h).collect():
        own = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        ids.setdefault(r.doc_id, []).append(own)
        start += len(own)
    assert got == want and [r[0] for r in got[:2]] == [None, None]
    shards = manifest.orderBy("part", "nth").collect()
    assert len(shards) > 4
    for doc_id in (None, -5, 0, 7, 9, 150):
        within = [s for s in shards if (s.first is None if doc_id is None else (s.first is None or s.first <= doc_id) and s.last is not None and doc_id <= s.last)]
        assert [x.tolist() for s in within for x in sstable.open_shard(s.path).get(doc_id)] == ids[doc_id]
    assert sum(len(sstable.open_shard(shards[0].path).get(i)) for i in range(10_000, 10_300)) == 0


def test_token_shards_of_nothing_and_corruption(spark, tmp_path):
    assert sstable.token_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    p = tmp_path / "x.sst"
    with open(p, "wb") as f:
        w = sstable.ShardWriter(f, 2)
        for i in range(100):
            w.add(i, np.arange(i + 1))
        w.close()
    data = bytearray(p.read_bytes())
    data[20] ^= 1
    p.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="corrupt"):
        list(sstable.open_shard(f"file://{p}"))


def test_encoder_equals_the_library():
    e = Encoder(sstable.byte_bpe_path(), most=50)
    texts = ["Hello there, it's  me", " lead", "trail ", "a\nb c\n\nd", "don't 12,5 x_y", "", "  x", "日本 語", "tab\t x", "a <|endoftext|> b"] * 3
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want and [x.tolist() for x in e.encode(texts)] == want


def test_encoder_keeps_frequent_words_when_it_forgets():
    class Counted:
        def __init__(self, tok):
            self.tok, self.given = tok, Counter()

        def encode_batch_fast(self, texts, **options):
            self.given.update(w for t in texts for w in t.split(" ")[1:])
            return self.tok.encode_batch_fast(texts, **options)

    e = Encoder(sstable.byte_bpe_path(), most=200)
    tok = e.tok
    e.tok = counted = Counted(tok)
    often = [f"often{i}" for i in range(60)]
    for n in range(30):
        texts = ["begin " + " ".join(random.Random(n).sample(often * 2, 120)), "begin " + " ".join(f"rare{n}x{i}" for i in range(100))]
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
        assert len(e.known) <= 400
    assert {w: counted.given[w] for w in often} == dict.fromkeys(often, 1)


def test_texts_with_odd_spaces_are_told_as_by_a_pattern():
    from tidemark.llm.encode import _WHITE, odd

    assert _WHITE == [c for c in map(chr, range(0x110000)) if re.match(r"[^\S ]", c)]
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choices([" ", "a", "é", "日", rng.choice(_WHITE)], (3, 6, 1, 1, 1), k=rng.randint(0, 9)))
        assert odd(t) == bool(re.search(r" \s|\s |\A | \Z", t))


def test_mixing_targets_and_ties(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)] + [(60, None, "s0"), (61, "a b", None), (None, "a b c", "s1"), (5, "w " * 5, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, range_rows=4).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) * 1.5 >= sum(r.taken for r in got) > sum(r["size"] for r in got) * 1.5 - 5
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and all(0 <= r.taken <= 2 * r["size"] for r in own)
    again = mixing.mix_sources(df, range_rows=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(df)
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).head()[0] == sum(r.taken for r in got) and mixed.columns == df.columns
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_mixed_documents_keep_columns_and_white_space(spark):
    rows = [(i, f"w{i}  a\tb\n\nc {i} " * 3, "x" if i % 3 else None, 7, 8, 9) for i in range(30)] + [(1, "w1  a\tb\n\nc 1 " * 3, "x", 7, 8, 9), (None, "p q", "x", 7, 8, 9), (None, "r s", "x", 7, 8, 9), (40, " ", "x", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, row int, n_chars long")
    mixed = mixing.mixed_documents(df, range_rows=4, share=1.3).collect()
    whole = {r[1] for r in rows}
    assert all((r["_size"], r["row"]) == (7, 8) for r in mixed) and mixed[0].__fields__ == df.columns
    short = [r.text for r in mixed if r.text not in whole]
    assert 1 <= len(short) <= 2 and all(any(w.startswith(t) for w in whole) and t[-1] not in " \t\n" for t in short)
    assert sum(len(r.text.split()) for r in mixed) == sum(int(t) for t in {(r.source, r.target) for r in mixing.mix_sources(df, share=1.3).collect()} for t in t[1:])
    plain = [r for r in mixed if r.text not in whole]
    assert all(r.n_chars == len(r.text) for r in plain)


def test_prefix_sums_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_BITS", 1)
    df = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', int(id % 5)) AS text", "CAST(id % 2 AS string) AS source")
    assert sorted(map(str, mixing.mix_sources(df, range_rows=8).collect())) == sorted(map(str, mixing.mix_sources(df, range_rows=10_000).collect()))


def test_language_of_held_out_documents(spark, sf):
    found = QUERIES["op4_language"](spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out and n_chars > 100")
    assert found.where("lang <> lang_pred").count() <= 0.03 * found.count() and found.where("score < 0 or score > 1").isEmpty()


def test_language_spans_and_defined_results(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    model = L.fit(docs)
    pick = {x: docs.where((F.col("lang") == x) & (F.length("text") > 600)).orderBy("doc_id").head().text[:400] for x in ("de", "es")}
    mixed = pick["de"] + " " + pick["es"]
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 !!"), (5, "Привет мир"), (6, "x" * 5000), (1, mixed)]
    got = L.label_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("_id").collect()
    assert [r.lang_pred for r in got if r._id in (2, 3, 4)] == ["und"] * 3 and got[0] == got[1]
    spans = got[0].spans
    assert (spans[0].lang, spans[-1].lang) == ("de", "es") and sum(s.end - s.start for s in spans if s.lang == ("de" if s.start < 400 else "es")) > 700
    assert next(r for r in got if r._id == 5).lang_pred in model.languages
    assert L.label_languages(docs.where("false"), model).count() == 0
    none = L.fit(docs.where("false"))
    assert {r.lang_pred for r in L.label_languages(docs.limit(5), none).collect()} == {"und"}


def plain_language(texts, labels, asked):
    """Operator 4 in plain Python: scripts narrow, runs of 2 to 4 letters score, dynamic programming labels."""
    import unicodedata

    names = sorted(set(labels))
    script = lambda c: next(s for first, s in reversed(L.SCRIPTS) if first <= ord(c))
    kind = lambda c: unicodedata.category(c)[0] if ord(c) < 0x33480 else "X"

    def words_of(text):
        out, word = [], ""
        for c in (text or "").lower() + " ":
            if kind(c) in "LM":
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    def runs(word):
        w = "\0" + word + "\0"
        return [tuple(w[i : i + n]) for n in (2, 3, 4) for i in range(len(w) - n + 1)]

    def bucket(run):
        h = sum((0 if c == "\0" else ord(c)) * 0x9E3779B97F4A7C15 * 0xD6E8FEB86659FD93**k for k, c in enumerate(run)) & 0xFFFFFFFFFFFFFFFF
        return int(W.mix(np.array([h], np.uint64) + np.uint64(len(run)))[0]) & (L.BUCKETS - 1)

    counts, used = {x: {} for x in names}, {x: {} for x in names}
    for text, x in zip(texts, labels, strict=True):
        for w in words_of(text):
            for r in runs(w):
                b = bucket(r)
                counts[x][b] = counts[x].get(b, 0) + 1
            for c in w:
                used[x][script(c)] = used[x].get(script(c), 0) + 1
    share = lambda x, b: np.log((counts[x].get(b, 0) + 0.1) / (sum(counts[x].values()) + 0.1 * L.BUCKETS))
    out = []
    for text in asked:
        ws = words_of(text)
        rows = []
        for w in ws:
            can = [used[x].get(script(w[0]), 0) >= L.SCRIPT_SHARE * sum(used[x].values()) and used[x].get(script(w[0]), 0) > 0 for x in names]
            rows.append([sum(share(x, bucket(r)) for r in runs(w)) if c else -1e4 for x, c in zip(names, can, strict=True)] if any(can) else [0.0] * len(names))
        best, back = rows[0] if rows else [], []
        for row in rows[1:]:
            came = [max(range(len(names)), key=lambda a: (best[a] - L.SWITCH * (a != b), a == b, -a)) for b in range(len(names))]
            back.append(came)
            best = [best[came[b]] - L.SWITCH * (came[b] != b) + row[b] for b in range(len(names))]
        path = [max(range(len(names)), key=lambda a: best[a])] if rows else []
        for came in reversed(back):
            path.insert(0, came[path[0]])
        letters = [sum(sum(kind(c) == "L" for c in w) for w, p in zip(ws, path, strict=True) if p == k) for k in range(len(names))]
        total = sum(letters)
        out.append((names[letters.index(max(letters))], max(letters) / total) if total else ("und", 0.0))
    return out


def test_languages_equal_plain_python(spark):
    rng = random.Random(16)
    alphabets = {"aa": "abcdeéß", "bb": "abcghi", "cc": "абвгд", "dd": "ابتث"}
    word = lambda x: "".join(rng.choice(alphabets[x]) for _ in range(rng.randint(1, 8)))
    text = lambda x, n: " ".join(word(x) for _ in range(n))
    rows = [(i, text(x, rng.randint(3, 30)) + " 12, x!", x) for i, x in enumerate(rng.choice(list(alphabets)) for _ in range(60))]
    asked = [r[1] for r in rows[:15]] + [text("aa", 12) + " " + text("cc", 9), text("bb", 5) + text("dd", 4) + " " + text("aa", 30), "ελλην abc", "日本 語", "e\u0301\u0301 ß", "", None, "1 2"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, rows_per_language=1000)
    taught = df.where(~L.held_out(F.col("doc_id"))).collect()
    want = plain_language([r.text for r in taught], [r.lang for r in taught], asked)
    got = L.label_languages(spark.createDataFrame([*enumerate(asked)], "doc_id long, text string").selectExpr("*", "1 AS lang_pred", "2 AS score", "3 AS _row"), model).orderBy("_id").collect()
    assert [r.lang_pred for r in got] == [x for x, _ in want] and np.allclose([r.score for r in got], [v for _, v in want])


def test_long_texts_are_scored_in_pieces(spark, monkeypatch, sf):
    model = L.fit(table(spark, sf, "documents"))
    pick = [r.text for r in table(spark, sf, "documents").where("n_chars > 500").limit(6).collect()]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["\n".join(pick)])], names=["_row", "_text"])
    (whole,) = L._labelled(iter([batch]), model, True)
    counts = L.counted(batch.column(1))
    monkeypatch.setattr(L, "PIECE", 700)
    (pieces,) = L._labelled(iter([batch]), model, True)
    assert pieces.to_pylist() == whole.to_pylist()
    assert all((x == y).all() for x, y in zip(L.counted(batch.column(1)), counts, strict=True))


def test_rare_languages_and_long_training_texts_are_learned(spark):
    rows = [(i, f"the common words of text {i} and more", "en") for i in range(400)] + [(1000 + i, "слово " * 20_000, "ru") for i in range(4)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=50)
    assert model.languages == ["en", "ru"]


def test_viterbi_equals_plain_dynamic_programming():
    rng = np.random.default_rng(8)
    counts = [0, 1, 63, 64, 65, 200, 0, 3]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    score = rng.normal(size=(offsets[-1], 3)) * 4
    got = L.viterbi(score, offsets, 5.0)

    def value(path, s):
        return sum(s[i, k] for i, k in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        s, best = score[a:b], None
        if a == b:
            continue
        v, back = s[0].copy(), []
        for k in range(1, len(s)):
            step = v[:, None] - 5.0 * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            v = step.max(axis=0) + s[k]
        best = v.max()
        assert abs(value(got[a:b].tolist(), s) - best) < 1e-6


def test_tiling_catches_reordered_passages_and_leaves_others(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(40)]
    other = [word() for _ in range(300)]
    docs = {
        1: other[:100] + item + other[100:], 2: item[20:] + other[:50] + item[:20], 3: other, 4: item[:20] + other, 5: [w.upper() + "," for w in item], 6: other[:5] + item[:12] + ["x"] + item[13:25] + ["y"] + item[26:], 9: [x for w in item for x in (w, "z")],
    }
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(7, None), (8, ""), (10, "alpha beta gamma")]
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", "alpha beta gamma"), ("c", None), ("d", ""), ("e", " ".join(item))], "item_id string, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS coverage")
    for block in (1_000_000, 20):
        got = sorted((r.doc_id, r.item_id) for r in D.contaminated(df, bench, block_words=block).collect())
        assert got == sorted([(i, x) for i in (1, 2, 5, 6) for x in "ae"] + [(10, "b")])
    assert D.contaminated(df.where("false"), bench).count() == 0 and D.contaminated(df, bench.where("false")).count() == 0


def tiles_by_hand(doc, item, least):
    """Wise's greedy string tiling as published: all matches of the greatest length over unmarked words, marked in order, until none of `least`."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while j + n < len(item) and i + n < len(doc) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        free_d[i : i + n], free_i[j : j + n] = [False] * n, [False] * n


def run_numbers(words_, names, least):
    return np.array([names.setdefault(tuple(words_[k : k + least]), len(names)) for k in range(len(words_) - least + 1)], np.int64)


@pytest.mark.parametrize("letters", ["a", "ab", "abcd"])
def test_tiles_equal_plain_greedy_tiling(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        least = rng.choice([2, 3, 5])
        doc, item = ([rng.choice(letters) for _ in range(rng.randint(least, 40))] for _ in range(2))
        names = {}
        assert D.tiles(run_numbers(doc, names, least), run_numbers(item, names, least), least) == tiles_by_hand(doc, item, least)


def test_contaminated_pairs_equal_plain_tiling(spark):
    rng = random.Random(14)
    items = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 25))] for _ in range(12)]
    docs = []
    for _ in range(60):
        words_ = [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 30))]
        for item in rng.sample(items, rng.randint(0, 2)):
            cut = rng.randint(0, len(item))
            words_ = words_[:5] + item[cut:] + words_[5:] + item[:cut]
        docs.append(words_)
    want = set()
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            least = min(5, len(item))
            found = tiles_by_hand(doc, item, least)
            covered = sum(n for *_, n in found)
            if covered >= 0.8 * len(item):
                want.add((d, k, len(found), covered, len(item)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_tiles, r.covered, r.n_words) for r in D.contaminated(df, bench, block_words=60).collect()}
    assert got == want and len(want) > 20


def test_tiling_of_a_long_text_of_one_word_is_bounded():
    import tracemalloc

    block = D.index_block(["x"], ["word " * 300])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["word " * 40_000])], names=["_id", "_text"])
    list(D._tiled(iter([batch]), block, 0.8))  # tables of powers are made once a process
    tracemalloc.start()
    (found,) = D._tiled(iter([batch]), block, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("coverage")[0].as_py() == 1.0 and peak < 150 << 20


def test_quality_learns_and_is_defined_everywhere(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = quality.fit(docs, labels.where(~held))
    got = quality.score(docs, model).join(labels.where(held), "doc_id")
    assert got.where((F.col("score") >= 0.5) == (F.col("quality") == 1)).count() > 0.9 * got.count()
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(docs.where("false"), model).count() == 0
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def surest(pool, fitted, bad, good, gone):
    """The search of co-training over features in memory."""
    out = []
    for v in (0, 1):
        p = quality._sigmoid(fitted[v].logit(pool[v]))
        order = [i for i in np.argsort(p, kind="stable") if i not in gone]
        low, high = [i for i in order[:bad] if p[i] < 0.1], [i for i in order[::-1][:good] if p[i] > 0.9]
        out.append((low + high, np.array([0.0] * len(low) + [1.0] * len(high))))
    gone.update(*(o[0] for o in out))
    return [(pool[0][i], pool[1][i], label) for i, label in out]


def test_cotraining_uses_the_pool():
    rng = np.random.default_rng(10)
    y = (rng.random(60) < 0.6).astype(float)
    views = tuple(rng.normal(size=(60, 5)) + 1.5 * y[:, None] for _ in range(2))
    hidden = (rng.random(2000) < 0.6).astype(float)
    pool = tuple(rng.normal(size=(2000, 5)) + 1.5 * hidden[:, None] for _ in range(2))
    gone = set()
    m = quality.cotrain(views, y, lambda f, bad, good: surest(pool, f, bad, good, gone), rounds=6, per_round=300)
    z = m.content.logit(pool[0]) * m.combined[0] * m.calibrated[0][0] + m.metadata.logit(pool[1]) * m.combined[1] * m.calibrated[1][0]
    assert ((z > np.median(z)) == (hidden == 1)).mean() > 0.85 and len(gone) > 500


def plain_features(r):
    """Both views' features of a row, by plain loops."""
    import math
    import re

    x, z = [0.0] * (quality.RUNS + 4), [0.0] * (quality.HASHED + quality.LENGTHS + 2)
    data, m = (r.text or "").encode(), 0xFFFFFFFF
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        h = ((a * 0x9E3779B1 & m) ^ (b * 0x85EBCA6B & m) ^ (c * 0xC2B2AE35 & m)) * 0x27D4EB2F & m
        x[h >> 23] += 1
    x[: quality.RUNS] = [math.sqrt(v / max(1, len(data) - 2)) for v in x[: quality.RUNS]]
    ws = re.findall(r"[^\W_]+", (r.text or "").lower())
    n = max(1, len(ws))
    x[quality.RUNS :] = [len(set(ws)) / n, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, sum(len(w.encode()) for w in ws) / max(1, len(data)), math.log1p(len(ws)) / 10]
    names = [f"source={r.source}", f"lang={r.lang}"]
    for name in [*names, "&".join(names)]:
        h = np.zeros(1, np.uint64)
        for byte in name.encode():
            h = W.mix(h * np.uint64(3) + np.uint64(byte))
        z[int(W.mix(h)[0] % np.uint64(quality.HASHED))] += 1
    v = -1 if r.n_chars is None else r.n_chars
    size = math.log2(max(v, 0) + 1)
    z[quality.HASHED], z[quality.HASHED + 1] = size / 10, float(v < 0)
    z[quality.HASHED + 2 + min(int(size), quality.LENGTHS - 1)] = 1
    return x, z


def test_quality_equals_plain_cotraining(spark, sf):
    """The registered way, with its searches on executors, against features by loops and a search in memory."""
    docs = table(spark, sf, "documents").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.selectExpr("*", "1 AS _id", "2 AS r1", "3 AS score", "4 AS y")
    labels = table(spark, sf, "labels")
    y_of = {r.doc_id: float(r.quality) for r in labels.collect()}
    rows = docs.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).collect()
    known = sorted((r for r in rows if r.doc_id in y_of), key=lambda r: (r.h, r.doc_id))
    rest = [r for r in rows if r.doc_id not in y_of]
    features = lambda some: tuple(np.array(m, np.float32) for m in zip(*map(plain_features, some), strict=True))
    pool, gone = features(rest), set()
    want = quality.cotrain(features(known), np.array([y_of[r.doc_id] for r in known]), lambda f, bad, good: surest(pool, f, bad, good, gone), 2, 20)
    got = quality.fit(docs, labels, rounds=2, per_round=20)
    assert got.fitted and want.fitted and len(gone) > 10
    z = [v.logit(f) * s + o for v, f, (s, o) in zip((want.content, want.metadata), features(rows), want.calibrated, strict=True)]
    plain = quality._sigmoid(z[0] * want.combined[0] + z[1] * want.combined[1] + want.combined[2])
    scored = {r.doc_id: r for r in quality.score(docs, got).collect()}
    assert all(abs(scored[r.doc_id].score - p) < 0.02 for r, p in zip(rows, plain, strict=True))


def test_metadata_never_sees_the_text(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels, rounds=1)
    a, b = (sorted((r.doc_id, r.p_metadata) for r in quality.score(d, model).collect()) for d in (docs, docs.withColumn("text", F.reverse("text"))))
    assert a == b


def written(ws, rows, second=None, shards=8):
    """Two replicas of (page_id, record) rows through files; second: page_id to its other record or None, and {"+": (id, record)} for an extra one."""
    spark, second = ws.spark, second or {}
    df = spark.createDataFrame(rows, "page_id long, record binary")
    laid, n = warc.laid_out(df, shards=shards)
    files = warc.write_replicas(ws, laid)
    other = [(i, second.get(i, r)) for i, r in rows if second.get(i, r) is not None] + second.get("+", [])
    moved = warc.laid_out(spark.createDataFrame(other, "page_id long, record binary"), shards=shards)[0].drop("shard")
    place = laid.groupBy("_id").agg(F.min("shard").alias("shard"))
    moved = moved.join(place, moved["_id"].eqNullSafe(place["_id"]), "left").select(moved["_id"], "record", "digest", F.coalesce("shard", F.lit(0)).cast("long").alias("shard"))
    a = warc.replica(ws, files[0], n)
    return a, warc.replica(ws, warc.write_replicas(ws, moved)[0], n, a.header)


def plain_record(i, body):
    return b"WARC/1.0\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)


def test_fixity_audit_finds_lost_added_resized_and_binary_records(spark):
    rows = [(i, plain_record(i, bytes([i % 256, 255, 254]) * (i % 90) * 40)) for i in range(2000)]
    ws = Workspace(spark, "t")
    a, b = written(ws, rows)
    same, counts = warc.audit(ws, a, b)
    assert same.count() == 0 and counts == [0] and a.leaves.count() == 2000
    a, b = written(ws, rows, {77: None, 5: plain_record(5, b"\xff" * 7), 1000: rows[1000][1][:-5] + b"?" + rows[1000][1][-4:], "+": [(5000, plain_record(5000, b"new"))]})
    bad, counts = warc.audit(ws, a, b)
    assert sorted((r.rid, r.status) for r in bad.collect()) == [("<r1000>", "corrupt"), ("<r5000>", "extra"), ("<r5>", "corrupt"), ("<r77>", "missing")]
    assert counts[0] == 1 and counts[-1] < a.levels[0].count()
    empty, none = written(ws, [])
    assert warc.audit(ws, empty, none)[0].count() == 0


def test_fixity_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "b" * i) for i in range(40)] + [(None, "n", f"null {i % 1500}") for i in range(3000)]
    rows += [(9, "u", f"html {i}") for i in range(5)] + [(9, "u", "html 0")] + [(5, "v", f"html {i}") for i in range(3)] + [(7, "w", "html")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record string, shard int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op2_merkle_fixity"](spark, str(tmp_path)).collect()
    want = pages.select("page_id", F.sha2(warc.record(F.col("page_id"), F.col("url"), F.col("html")), 256)).collect()
    assert sorted((str(r.page_id), r.sha256) for r in got) == sorted((str(i), d) for i, d in want)
    assert len({(r.shard, r.record_offset) for r in got}) == len(rows) and len({r.shard for r in got if r.page_id is None}) > 50
    assert all(r.status == {5: "corrupt", 7: "missing"}.get(r.page_id, "ok") for r in got)
    pages.where("false").write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert QUERIES["op2_merkle_fixity"](spark, f"{tmp_path}/empty").count() == 0


def test_one_of_two_records_of_an_id_is_damaged(spark):
    leaf = lambda at, r, x: (0, at, 9, r, x)
    ws = Workspace(spark, "t")
    schema = "shard long, at long, n_bytes long, rid string, digest string"
    first = warc.tree(ws, spark.createDataFrame([leaf(0, "r", "aa"), leaf(9, "r", "bb"), leaf(18, "s", "cc"), leaf(27, "s", "cc"), leaf(36, "s", "dd")], schema))
    second = warc.tree(ws, spark.createDataFrame([leaf(0, "r", "ab"), leaf(9, "r", "bb"), leaf(18, "s", "cc"), leaf(27, "s", "dd")], schema), like=first.header)
    assert {(r.at, r.status) for r in warc.audit(ws, first, second)[0].collect()} == {(0, "corrupt"), (27, "missing")}
    with pytest.raises(ValueError):
        warc.audit(ws, first, warc.tree(ws, second.leaves, 500))


def test_records_are_shuffled_as_gzip_members(spark):
    def files():
        it = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = {}
        while it.hasNext():
            f = it.next()
            out[f.getPath()] = f.length()
        return out

    words = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(2000)]
    pages = spark.createDataFrame([(i, f"u{i}", " ".join(random.Random(i).choices(words, k=800))) for i in range(400)], "page_id long, url string, html string")
    ws = Workspace(spark, "t")
    rows, n = warc.laid_out(pages.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")), shards=4)
    before = files()
    made = warc.write_replicas(ws, rows, n, warc.damage(F.col("record").cast("string"), F.col("_id")))
    shuffled = sum(size for path, size in files().items() if path not in before and "shuffle" in path)
    paths = [[r.path.removeprefix("file://") for r in m.collect()] for m in made]
    written = sum(os.path.getsize(p) for p in paths[0])
    assert 0 < shuffled < 1.1 * written
    second = {r.rid: r.digest for r in warc.read_records(made[1]).collect()}
    first = {r.rid: r.digest for r in warc.read_records(made[0]).collect()}
    assert len(first) == 400 and len(second) == 399 and sum(first[r] != second[r] for r in second) == 1


def test_warc_files_round_trip(spark, tmp_path, monkeypatch):
    import gzip

    from tidemark.llm import warcfile

    pages = spark.createDataFrame([(1, "http://a", "<p>é\r\n\r\nx</p>"), (2, None, None), (3, "http://b", "WARC/1.0\r\n")], "page_id long, url string, html string")
    records = pages.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    ws = Workspace(spark, "t")
    laid, _ = warc.laid_out(records, shards=2)
    back = warc.read_records(warc.write_replicas(ws, laid)[0]).collect()
    want = [r.record.encode() for r in records.collect()]
    assert sorted(bytes(r.record) for r in back) == sorted(want) and all(r.digest == hashlib.sha256(r.record).hexdigest() and r.n_bytes == len(r.record) for r in back)
    monkeypatch.setattr(warcfile, "CHUNK", 7)
    large = [plain_record(1, b"\xff\x00" * 40), plain_record(2, b""), *want]
    for name, data in (("a.warc", b"".join(large)), ("a.warc.gz", b"".join(gzip.compress(r) for r in large))):
        (tmp_path / name).write_bytes(data)
        got = list(warcfile.scan(f"file://{tmp_path}/{name}"))
        assert [r for *_, r in got] == large and [g[0] for g in got[:3]] == [0, len(large[0]), len(large[0]) + len(large[1])] and [g[1] for g in got[:2]] == ["<r1>", "<r2>"]
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(large[0])[:-3])
    with pytest.raises(ValueError):
        list(warcfile.scan(f"file://{tmp_path}/cut.warc.gz"))
    for bad in (b"WARC/1.0\r\ncontent-length: 9\r\n\r\nabc", b"junk", plain_record(1, b"x") + b"junk that goes on\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warcfile.split_records(iter([bad])))


def test_line_chunks_shift_and_keep_the_first(spark):
    rng = random.Random(11)
    line = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(6))
    shared = [line() for _ in range(60)]
    texts = ["\n".join([line() for _ in range(k + 1)] + shared + [line()]) for k in range(12)] + [None, "", "\n\n\n\n\n\n\n\n", "one", "\n\n\n\n\n\n\n\n"]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS chunks", "2 AS h1", "3 AS gone")
    got = {r.doc_id: r for r in lines.remove_repeated_chunks(df).collect()}
    assert got[0].n_removed == 0 and got[0].kept_text == texts[0]
    for k in range(1, 12):
        kept = got[k].kept_text.split("\n")
        assert kept[: k + 1] == texts[k].split("\n")[: k + 1] and len(kept) < k + 20
    assert got[12].kept_text == "" and got[14].n_removed == 0 and got[16].kept_text == texts[16]
    assert lines.remove_repeated_chunks(df.where("false")).count() == 0


def chunks_by_hand(rows):
    """op10 in plain Python: (doc_id, text) to what is left of each."""
    cut = {}
    for i, text in set(rows):
        lines_, hashes, chunk, ended = (text or "").split("\n"), [0], [], False
        for k, line in enumerate(lines_):
            hashes.append(int(hashlib.md5(line.encode()).hexdigest()[:6], 16))
            chunk.append(line)
            ended = not ended and (hashes[-1] + 257 * hashes[-2]) % 1_000_003 % 4 != 0
            if ended or k == len(lines_) - 1:
                cut.setdefault((i, text), []).append(chunk)
                chunk = []
    seen, out = set(), {}
    for key in sorted(cut, key=lambda x: (x[0] is not None, x[0] or 0)):
        kept = []
        for c in cut[key]:
            body = "\n".join(c)
            if len(c) > 1 and body.strip(" \t\r\n") and body in seen:
                continue
            seen.add(body if len(c) > 1 else None)
            kept.append(body)
        out[key] = "\n".join(kept)
    return out


def test_shared_passages_of_three_to_six_lines(spark):
    """Against plain Python, and how many of the passages between different neighbours lose lines."""
    rng = random.Random(15)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    caught = {}
    rows, where = [], {}
    for n in (3, 4, 5, 6):
        for k in range(40):
            passage = [line() for _ in range(n)]
            for _ in range(2):
                where[len(rows)] = (n, passage)
                rows.append((len(rows), "\n".join([line() for _ in range(rng.randint(1, 3))] + passage + [line() for _ in range(rng.randint(1, 3))])))
    rows += [(None, "x"), (1000, None), (1001, ""), (1002, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunks", "2 AS kept_text")
    got = {r.doc_id: r for r in lines.remove_repeated_chunks(df).collect()}
    for (i, text), kept in chunks_by_hand(rows).items():
        assert got[i].kept_text == kept, (i, text)
    for i, (n, passage) in where.items():
        own = [x for x in rows[i][1].split("\n") if x not in passage]
        assert [x for x in got[i].kept_text.split("\n") if x not in passage] == own
        if i % 2:
            caught.setdefault(n, []).append(got[i].n_removed > 0)
    share = {n: sum(c) / len(c) for n, c in caught.items()}
    assert share[3] > 0.3 and share[6] > 0.5, share


def plain_pipeline(spark, rows, items):
    """The five stages over (doc_id, text, source) in plain Python."""
    import math

    from tests.llm.test_near import classes, similarity
    from tokenizers import Tokenizer

    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and similarity(a[1], b[1]) >= 0.8]
    root = classes(links, [r[0] for r in rows])
    rows = [r for r in rows if root[r[0]] == r[0]]
    held = lambda text, item: sum(n for *_, n in tiles_by_hand(text.lower().split(), item.lower().split(), 5)) >= 0.8 * len(item.split())
    rows = [r for r in rows if not any(held(r[1], i) for i in items)]
    size = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in {r[2] for r in rows}}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    capped, total = set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in size if s not in capped))
        over = {s for s in size if s not in capped and level * weight[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    mixed = []
    for s in size:
        left = math.floor(2 * size[s] if s in capped else level * weight[s])
        own = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest())
        while left > 0:
            for r in own:
                n = len(r[1].split())
                if left > 0:
                    mixed.append((r[0], r[1] if left >= n else " ".join(r[1].split()[:left])))
                    left -= min(left, n)
    tok, start, out = Tokenizer.from_file(sstable.byte_bpe_path()), 0, []
    order = spark.createDataFrame(mixed, "i long, t string").orderBy("i", F.xxhash64("t")).collect()
    for r in order:
        ids = [*tok.encode(r.t, add_special_tokens=False).ids, 2]
        out.append((r.i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(17)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "sigma", "rho", "pi", "mu", "nu", "xi"]) + str(rng.randint(0, 30)) for _ in range(n))
    items = [prose(20), prose(12)]
    rows = [(i, prose(rng.randint(8, 60)), f"s{i % 4}") for i in range(40)]
    rows += [(40 + k, rows[k][1] if k % 2 else rows[k + 10][1] + " tail", f"s{k % 3}") for k in range(10)]
    rows += [(60, prose(10) + " " + items[0], "s1"), (61, " ".join(items[1].split()[6:]) + " " + prose(9) + " " + " ".join(items[1].split()[:6]), "s2"), (62, None, "s0"), (63, "12 34 !", "s0"), (64, "", "s1")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in P.run(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == plain_pipeline(spark, rows, items) and not {60, 61, 62, 63, 64} & {r[0] for r in got}


def test_pipeline_of_nothing_and_language_decisions(spark, tmp_path, sf):
    import corpus_pipeline as P

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    stage = dict(P.STAGES)["language_id"]
    named = stage(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, F.col("lang"))), sf)
    assert named.columns == docs.columns and named.where("lang is null").count() == 0
    assert named.join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id").where("lang <> l and n_chars > 100").count() <= 0.03 * docs.count()
    unlabelled = stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf)
    assert unlabelled.count() == named.count() > 0  # nothing was learned: only texts without letters go
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = table(spark, sf, "documents").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34", "en", "x", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    stage = dict(P.STAGES)
    named = stage["language_id"](spark, docs, sf)
    assert ids(docs) - ids(named) == {-1, -2} and named.columns == docs.columns
    bench = [r.text for r in table(spark, sf, "benchmark").collect()]
    clean = stage["benchmark_decontamination"](spark, named, sf)
    assert ids(named) - ids(clean) == {r.doc_id for r in named.collect() if any(b in r.text for b in bench)}
    assert [n for n, _ in P.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
