from __future__ import annotations

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from symweave.llm import langid, quality
from symweave.llm.common import held_out

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "bb"]


def plain_probability(word, pieces, p):
    """Sum over all segmentations, by listing them."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        product = 1.0
        for i, j in zip(at, at[1:], strict=False):
            product *= p[pieces.number[word[i:j]]] if word[i:j] in pieces.number else langid.UNKNOWN if j - i == 1 else 0.0
        total += product
    return total


def test_forward_sums_all_segmentations():
    pieces, rng = langid.Pieces(PIECES), np.random.default_rng(1)
    p = rng.random((len(PIECES) + 1, 3))
    p[0] = langid.UNKNOWN
    words = ["▁", "▁a", "▁abab", "▁bxa", "ba", "▁aabbaabb", "é", "▁\U0001f642a"]
    expected = [[plain_probability(w, pieces, p[:, j]) for j in range(3)] for w in words]
    assert np.allclose(np.exp(langid.word_scores(words, pieces, p)), expected)


def test_expected_counts_are_those_of_all_segmentations():
    pieces, p = langid.Pieces(PIECES), np.full(len(PIECES) + 1, 0.1)
    p[0] = langid.UNKNOWN
    word, expected = "▁abab", np.zeros(len(PIECES) + 1)
    whole = plain_probability(word, pieces, p)
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[i:j] for i, j in zip(at, at[1:], strict=False)]
        if all(x in pieces.number for x in parts):
            for x in parts:
                expected[pieces.number[x]] += math.prod(p[pieces.number[y]] for y in parts) / whole
    assert np.allclose(langid.expected_counts([word], np.array([1.0]), pieces, p), expected)


def test_table_of_pieces_finds_all_and_nothing_else():
    pieces = langid.Pieces([f"p{i}" for i in range(3000)] + ["", "x" * 30, "p1"])
    assert len(pieces.number) == 3001
    words = ["p7p2999", "zzz", "p", "x" * 33]
    grid, lengths = pieces.lattice(words)
    for w, word in enumerate(words):
        for i in range(1, grid.shape[0] + 1):
            for k in range(1, grid.shape[1] + 1):
                expected = pieces.number.get(word[i - k : i], 0) if k <= i <= len(word) else 0
                assert grid[i - 1, k - 1, w] == expected
    assert lengths.tolist() == [7, 3, 1, 33]


WORDS = {"en": "the of and to that with".split(), "de": "und der nicht das mit über".split()}


def language_rows(n, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 40))), lang) for i, lang in enumerate(["en", "en", "de"] * n)]
    return [*rows, (9000, None, "en"), (9001, "", "de"), (9002, "123 ?! 4", "de"), (9003, "the and", None), (9004, "THE AND OF THAT", None), (9005, "x" * 100_000 + " the of and", "en"), (9006, "日本", "de")]


def test_languages_are_learnt_and_held_out_rows_are_not(spark):
    docs = spark.createDataFrame(language_rows(30), "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("extra", F.lit(1))
    model = langid.train(docs, ~held_out(F.col("doc_id")))
    out = langid.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "extra", "lang_pred", "score"]
    rows = out.collect()
    assert all(r["lang_pred"] == r["lang"] for r in rows if r["doc_id"] < 9000)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert by[9000] == by[9001] == by[9002] == ("und", 0.0)
    assert by[9003][0] == by[9004][0] == "en" and all(0 <= s <= 1 for _, s in by.values())
    again = langid.predict(docs.drop("lang"), langid.train(docs, ~held_out(F.col("doc_id"))))
    assert {r["doc_id"]: r["lang_pred"] for r in again.collect()} == {k: v[0] for k, v in by.items()}
    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert langid.train(wrong, ~held_out(F.col("doc_id"))).languages == ["de", "en"]


@pytest.mark.parametrize("run", [5, 20, 40, 3000])
def test_languages_without_spaces_are_told_apart(spark, run):
    rng = random.Random(run)
    rows = [(i, "".join(rng.choices("abcdefgh" if i % 2 else "ijklmnop", k=run)), "x" if i % 2 else "y") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = langid.predict(docs, langid.train(docs, ~held_out(F.col("doc_id")))).collect()
    assert all(r["lang_pred"] == r["lang"] for r in said)


@pytest.mark.parametrize("n", [1, 32, 33, 40, 56, 57, 500])
def test_windows_cover_a_word(n):
    word = "▁" + "".join(chr(0x4E00 + i) for i in range(n))
    cut = list(langid.windows(word))
    assert cut[0] == word[:33] and all(len(x) <= 32 for x in cut[1:]) and "".join([cut[0], *[x[langid.AGAIN :] for x in cut[1:]]]) == word


def test_long_words_are_summed_over_all_segmentations(monkeypatch):
    """Against exact fractions, over windows and far below the smallest float."""
    pieces, rng = langid.Pieces(PIECES), np.random.default_rng(3)
    p = rng.random((len(PIECES) + 1, 2)) * 1e-4
    p[0] = langid.UNKNOWN
    words = ["▁" + "".join(rng.choice(list("abx"), n)) for n in (1, 7, 8, 9, 40, 129, 300, 700)]
    expected = []
    for w in words:
        for j in range(2):
            values = [Fraction(1)]
            for i in range(1, len(w) + 1):
                steps = [(k, pieces.number.get(w[i - k : i], 0)) for k in range(1, min(i, pieces.longest) + 1)]
                values.append(sum(values[i - k] * Fraction(float(p[n, j])) for k, n in steps if n or k == 1))
            expected.append(math.log(values[-1].numerator) - math.log(values[-1].denominator))
    assert np.allclose(langid.word_scores(words, pieces, p).ravel(), expected, rtol=1e-12)
    monkeypatch.setattr(langid, "CELLS", 100)
    monkeypatch.setattr(langid, "WINDOW", 5)
    assert np.allclose(langid.word_scores(words, pieces, p).ravel(), expected, rtol=1e-12)


def test_the_whole_vocabulary_of_words_is_used():
    pieces = langid.Pieces.load(langid.vocabulary_path())
    assert {"▁international", "▁particularly", "▁communication"} <= set(pieces.number) and pieces.longest == 16
    assert langid.Pieces.load(langid.vocabulary_path()) is pieces


@pytest.mark.parametrize(("text", "words"), [("² ½ ① Ⅷ 3 _", []), ("a²b", ["a", "b"]), ("ÀB c1d", ["àb", "c", "d"]), ("日本", ["日本"]), ("नमस्ते", ["नमस्ते"])])
def test_words_are_letters(text, words):
    assert langid.words_of(text) == words


def test_memo_of_words_may_overflow(spark, monkeypatch):
    monkeypatch.setattr(langid, "MEMO_BYTES", 900)
    monkeypatch.setattr(langid, "HELD", 60)
    docs = spark.createDataFrame(language_rows(10), "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    texts = [r[1] for r in language_rows(10)]
    scorer = langid.Scorer(model)
    first = [scorer.predict([t])[0] for t in texts]
    assert first == [scorer.predict([t])[0] for t in texts]
    assert 0 < scorer._bytes <= langid.MEMO_BYTES and len(scorer._place) < 12
    monkeypatch.setattr(langid, "HELD", 10**9)
    for (a, s), (b, t) in zip(first, langid.Scorer(model).predict(texts), strict=True):
        assert a == b and s == pytest.approx(t)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "a", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, F.lit(True))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs, F.lit(True))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0), F.lit(True))).count() == 0


def quality_rows(n):
    rng = random.Random(5)
    good, bad = "a calm line of plain words that people read".split(), "BUY!! NOW$$$ click### free&&& win%%%".split()
    return [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randint(5, 60))), int(i % 3 > 0)) for i in range(n)]


def test_quality_separates_held_out_rows(spark):
    rows = quality_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "word " * 100_000), (None, "a calm line")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(1, None, 1), (2, 7, 0), (None, 1, 0), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, quality.train_quality(docs, labels))
    scores = {r["doc_id"]: r["score"] for r in out.collect()}
    held = {r[0] for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert len(held) > 40 and all((scores[i] >= quality.THRESHOLD) == bool(y) for i, _, y in rows if i in held)
    assert scores[900] == scores[901] and all(0 <= s <= 1 for s in scores.values())
    shuffled = docs.orderBy(F.desc("text"))
    assert {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.train_quality(shuffled, labels)).collect()} == scores


def test_quality_learns_nothing_from_held_out_rows_and_needs_labels(spark):
    rows = quality_rows(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train_quality(docs, labels) == quality.train_quality(docs, turned)).all()
    none = quality.train_quality(docs, labels.limit(0))
    assert not none.any() and {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_sparse_scores_are_plain_dot_products():
    weights, features = np.random.default_rng(2).normal(size=(1 << quality.BITS) + 1), quality.Features()
    for text in ("", "one", "one one two", "a, b! A"):
        slots = features.slots(text)
        total = sum(weights[i] * quality.SCALE / len(slots) for i in slots) + weights[-1]
        assert quality.score_text(weights, features, text) == pytest.approx(1 / (1 + math.exp(-total)))


def plain_ftrl(rows, alpha, beta, l1, l2, epochs):
    """FTRL-proximal as it was published, coordinate by coordinate: rows of ({slot: value}, label); "bias" has no penalty."""
    z, n = {}, {}

    def weight(i):
        a, b = (0.0, 0.0) if i == "bias" else (l1, l2)
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= a else -(zi - math.copysign(a, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + b)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_is_plain_ftrl():
    rows = quality_rows(40)
    weights = quality.train([t for _, t, _ in rows], [y for _, _, y in rows], bits=10)
    features, plain = quality.Features(10), []
    for _, t, y in rows:
        slots = features.slots(t).tolist()
        plain.append(({i: float(np.float32(slots.count(i) * (quality.SCALE / len(slots)))) for i in set(slots)}, y))
    expected = plain_ftrl(plain, quality.ALPHA, quality.BETA, quality.L1, quality.L2, quality.EPOCHS)
    assert weights[-1] == pytest.approx(expected.pop("bias")) and any(expected.values())
    assert np.allclose(weights[list(expected)], list(expected.values())) and np.count_nonzero(weights[:-1]) == sum(map(bool, expected.values()))


def test_repeated_ids_do_not_break_the_bound_nor_teach_twice(spark):
    rows = quality_rows(60)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    once = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    often = once.unionByName(once.where("doc_id < 9")).unionByName(once)
    assert (quality.train_quality(once, labels) == quality.train_quality(often, labels)).all()
    hot = spark.range(5000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert 300 < quality.training_rows(hot, labels, bound=400).count() < 500
    assert quality.training_rows(hot, labels, chars=20_000).agg(F.sum(F.length("text"))).first()[0] < 24_000


def test_quality_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    weights = quality.train_quality(docs, labels)
    assert not weights.any() and quality.score_quality(docs, weights).count() == 0


def test_the_training_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert 300 < quality.training_rows(docs, labels, bound=400).count() < 500
