"""Top-k search and piece encoding against brute force and the installed library."""
import math
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkaudit.llm import pieces, top_k
from sparkaudit.llm.pieces import MARK, LongWords, Vocabulary, decode, encode, encode_words, load_vocabulary

MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")


@pytest.mark.parametrize("shard,block,look", [(8192, 1024, 4096), (16, 4, 20), (8, 50, 0)])
def test_top_k_equals_comparing_all(spark, shard, block, look, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", shard)
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "FIRST_LOOK", look)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(70)] + [(5, rows[5][1])] * 2
    rows += [(300, None), (301, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (302, [math.nan] * 6), (303, [math.inf] * 6), (None, [1.0] * 6), (304, [9.0] * 3), (350, [1.0] * 3)]
    df = spark.createDataFrame([(k, v, "a") for k, v in rows], "vec_id long, embedding array<float>, rank string")
    sound = {k: [math.floor(256 * float(np.float32(x))) for x in v] for k, v in rows
             if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (k for k in sound if k % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), k) for k, v in sound.items() if k != q and len(v) == len(sound[q]))
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores[:5])]
    got = top_k.top_k(df, df.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert top_k.top_k(df.where("false"), df.where("false")).collect() == []
    assert top_k.top_k(df, df.where("false")).collect() == []


@pytest.fixture(scope="module")
def model():
    if not MODEL.exists():
        pytest.skip("tokenizer files not present")
    sentencepiece = pytest.importorskip("sentencepiece")
    return load_vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=str(MODEL))


TEXTS = ["", None, "   ", "a  b\n\n c\t", "漢字😀 x ", " lead", "x" * 900 + " " + "é" * 70, "thethethe" * 40, "\n", "a\n", "<s> </s> <0x0A>",
         "hello world, aaaaaaaaaaaa ....... 1234567", "ﬁ Ａ ​ ¼", "the quick brown fox", "The and attion to thanedble the, anea.", "the quick brown fox"]


@pytest.mark.parametrize("common", [500_000, 3, 0])
def test_ids_equal_the_library_and_decode_back(spark, model, common, monkeypatch):
    monkeypatch.setattr(pieces, "COMMON", common)
    vocabulary, library = model
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)] + [(1, None, "again")], "doc_id long, text string, ids string")
    encoded = encode(df, vocabulary)
    rows = decode(encoded.withColumnRenamed("text", "before"), vocabulary).collect()
    assert len(rows) == len(TEXTS) + 1 and encoded.columns == ["doc_id", "text", "ids", "n_tokens"]
    for r in rows:
        assert r["ids"] == (library.encode(r["before"]) if r["before"] else []) and r["n_tokens"] == len(r["ids"])
        assert r["text"] == (r["before"] or "")
    assert encode(df.where("false"), vocabulary).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [3 + 0xE2])], "doc_id long, ids array<int>")
    assert [r["text"] for r in decode(odd, vocabulary).orderBy("doc_id").collect()] == [None, "�"]


@settings(max_examples=300, deadline=None)
@given(word=st.text(alphabet="abthenigo", min_size=1, max_size=40))
def test_long_word_merges_equal_the_library(model, word):
    vocabulary, library = model
    test_long_word_merges_equal_the_library.words = getattr(test_long_word_merges_equal_the_library, "words", None) or LongWords(vocabulary)
    code = test_long_word_merges_equal_the_library.words.encode(MARK + word)
    assert np.frombuffer(code, dtype=">i4").tolist() == library.encode(word)


def best_cost(word, scores, worst):
    cost = [0.0]
    for e in range(1, len(word) + 1):
        cost.append(min(cost[s] + (-scores[word[s:e]] if word[s:e] in scores else worst if e - s == 1 else math.inf) for s in range(e)))
    return cost[-1]


def test_unigram_paths_are_the_likeliest(spark):
    rnd = random.Random(6)
    names = sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 5))) for _ in range(40)} - {"b"})
    scores = {p: -rnd.uniform(1, 9) for p in names}
    vocabulary = Vocabulary([(p, i + 1, scores[p]) for i, p in enumerate(names)], [], 0, "unigram", [""] + names)
    worst = max(-s for s in scores.values()) + 10
    words = sorted({"".join(rnd.choices("abcd", k=rnd.randrange(1, 14))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition("word")
    long_words = LongWords(vocabulary)
    rows = encode_words(df, vocabulary).collect()
    assert sorted(r["word"] for r in rows) == words
    for r in rows:
        for code in (bytes(r["ids"]), long_words.encode(r["word"])):
            ids = np.frombuffer(code, dtype=">i4").tolist()
            cost = sum(worst if i == 0 else -scores[names[i - 1]] for i in ids)
            assert cost == pytest.approx(best_cost(r["word"], scores, worst))


def test_a_vocabulary_across_words_is_refused():
    with pytest.raises(ValueError):
        Vocabulary([(f"a{MARK}b", 1, -1.0)], [], 0)


def test_folded_and_long_words_agree_at_the_limit(spark, model):
    vocabulary, _ = model
    rnd = random.Random(8)
    words = [MARK + "".join(rnd.choices("etaoinshr", k=n)) for n in (57, 58, 59)]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition("word")
    long_words = LongWords(vocabulary)
    assert {r["word"]: bytes(r["ids"]) for r in encode_words(df, vocabulary).where(F.length("word") <= 60).collect()} == {w: long_words.encode(w) for w in words}


@pytest.mark.parametrize("limit", [100_000, 2])
def test_copies_and_repeated_rows_make_no_large_group(spark, model, limit, monkeypatch):
    from sparkaudit.operators import scale
    vocabulary, library = model
    monkeypatch.setattr(scale, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(pieces, "COMMON", 0)
    monkeypatch.setattr(pieces, "COPIES", 4, raising=False)
    text = "only copies hold these words"
    rows = [(7, text)] * 60 + [(100 + i, text) for i in range(60)] + [(300, "these others"), (301, "x" * 80 + " words"), (302, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lattices, encode_words = [], pieces.encode_words
    monkeypatch.setattr(pieces, "encode_words", lambda words, *a: lattices.append(words) or encode_words(words, *a))
    got = encode(df, vocabulary).collect()
    assert len(got) == len(rows) and all(r["ids"] == (library.encode(r["text"]) if r["text"] else []) for r in got)
    for words in lattices:
        assert not any(kind.startswith("array") for _, kind in words.dtypes)
        found = [r["word"] for r in words.collect()]
        assert len(found) == len(set(found))
    keys = df.withColumn("_key", F.xxhash64("text", F.pmod(F.xxhash64("doc_id"), F.lit(4))))
    common = spark.createDataFrame([], "word string")
    groups = pieces.rare_words(keys, common, vocabulary, "text").collect()
    assert len(groups) <= 4 + 2 and max(len(r["_pairs"]) for r in groups) == len(text.split())


def test_a_lost_word_is_an_error(spark, model, monkeypatch):
    vocabulary, _ = model
    encode_words = pieces.encode_words
    monkeypatch.setattr(pieces, "encode_words", lambda *a: encode_words(*a).where(F.col("word") != MARK + "lost"))
    df = spark.createDataFrame([(1, "a lost word")], "doc_id long, text string")
    with pytest.raises(Exception, match="lost the word"):
        encode(df, vocabulary).collect()


def test_rows_that_share_an_id_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (50, [0.0, 2.0]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in top_k.top_k(df, df.where("vec_id % 50 = 0"), 4).collect()]
    one = 256 * 256
    assert sorted(got) == [(0, 1, 1, 3 * one), (0, 2, 2, 2 * one), (0, 3, 50, one), (0, 4, 1, one // 2),
                           (50, 1, 1, 3 * one), (50, 2, 2, 2 * one), (50, 3, 3, 2 * one), (50, 4, 0, one)]


def test_columns_named_like_the_inner_ones_and_very_long_texts(spark, model):
    vocabulary, library = model
    names = ["_key", "_text", "_rest", "_packed", "_pairs", "_whole", "_w", "word", "edges", "none", "c0", "ids"]
    texts = ["a few words", None, "", "some thing " * 20_000 + "x" * 5_000]
    rows = [(i, *[f"{n}{i}" for n in names], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ["doc_id", *names, "text"]).replace("doc_id string", "doc_id long"))
    got = {r["doc_id"]: r.asDict() for r in encode(df, vocabulary).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        assert got[i]["text"] == t and got[i]["ids"] == (library.encode(t) if t else [])
        assert all(got[i][n] == f"{n}{i}" for n in names if n != "ids")


def test_a_character_without_a_piece_falls_back_inside_a_lattice(spark, model, monkeypatch):
    vocabulary, library = model
    monkeypatch.setattr(pieces, "COMMON", 0)
    texts = ["mixed \U00010348and \U00010348", "\U00010348", "plain 一\U0001f9ff words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["text"]: r["ids"] for r in encode(df, vocabulary).collect()} == {t: library.encode(t) for t in texts}


def test_stored_words_leave_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    table = pieces.stored(spark.createDataFrame([(f"w{i % 7}",) for i in range(50)], "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    assert sorted(r["n"] for r in table.collect()) == [7] * 6 + [8] and pieces.stored_rows(table) == 7
    assert spark.conf.get(setting, None) == before
    assert tracker.shuffleStatuses().size() <= held


@pytest.mark.parametrize("shift,width", [(0, 2), (1 << 16, 4)])
def test_ids_of_any_width_reach_the_documents(spark, model, shift, width, monkeypatch):
    vocabulary, library = model
    monkeypatch.setattr(pieces, "COMMON", 0)
    moved = Vocabulary([(p, i + shift, s) for p, i, s in vocabulary.pieces], [i + shift for i in vocabulary.byte_ids], vocabulary.unknown)
    assert pieces.id_width(moved) == width
    text = f"a {MARK} mark  and \U00010348 words"
    row = encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), moved).first()
    assert row["ids"] == [i + shift for i in library.encode(text)]
