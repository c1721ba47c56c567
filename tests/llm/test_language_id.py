"""The conditional random field against sums over all paths, and held-out accuracy."""

from __future__ import annotations

import itertools
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, word_chain
from tidemark.llm.language_id import fit_languages, identify_languages, label_words, language_sample
from tidemark.llm.word_chain import WordChain, fit

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"
ODD = [None, "", " 12 !", "́ ²", "a", "日本語", "\U0001d49c", "x" * 300_000, "le la " * 60_000]


def chain(k, seed=1):
    draws = np.random.Generator(np.random.PCG64(seed))
    weights = draws.normal(size=((1 << word_chain.BITS) + 1, k))
    weights[-1] = 0
    return WordChain([f"l{j}" for j in range(k)], weights, draws.normal(size=k), draws.normal(size=(k, k)))


def all_paths(model, evidence):
    """Chances by the sum over every path."""
    n, k = evidence.shape
    chances = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(model.start[path[0]] + sum(model.steps[a, b] for a, b in itertools.pairwise(path)))
        weight *= np.prod([evidence[t, y] for t, y in enumerate(path)])
        for t, y in enumerate(path):
            chances[t, y] += weight
    return chances / chances.sum(axis=1, keepdims=True)


@pytest.mark.parametrize(("chunk", "chunks"), [(32, 8192), (3, 2), (1, 1)])
def test_forward_backward_equals_all_paths(monkeypatch, chunk, chunks):
    monkeypatch.setattr(word_chain, "CHUNK", chunk)
    monkeypatch.setattr(word_chain, "CHUNKS", chunks)
    model = chain(3)
    words = ["ab", "c", "日本", "ab", "dd", "eee", "f"]
    evidence = model.evidence(words)
    sizes = np.array([0, 7, 1, 0, 4, 5])
    numbers = np.random.Generator(np.random.PCG64(2)).integers(0, 7, sizes.sum())
    got = np.zeros((sizes.sum(), 3))
    for places, chances in model.marginals(numbers, sizes, evidence):
        got[places] = chances
    low = 0
    for size in sizes[sizes > 0]:
        assert got[low : low + size] == pytest.approx(all_paths(model, evidence[numbers[low : low + size]]))
        low += size


def test_slopes_equal_differences():
    """The fit's expected counts are those of all paths."""
    model = chain(2)
    evidence = model.evidence(["aa", "b", "cc"])
    given = evidence[np.array([[0, 1, 2, 0], [2, 2, 0, 0]])]
    inside = np.array([[True] * 4, [True, True, False, False]])
    chances, steps = word_chain._expected(given, inside, model)
    assert chances[0] == pytest.approx(all_paths(model, given[0]))
    assert chances[1, :2] == pytest.approx(all_paths(model, given[1, :2]))
    assert steps.sum() == pytest.approx(4)
    nudged = 1e-6

    def likelihood(steps):
        other = WordChain(model.labels, model.weights, model.start, steps)
        total = 0
        for row, n in ((given[0], 4), (given[1], 2)):
            total += np.log(
                sum(
                    np.exp(other.start[p[0]] + sum(steps[a, b] for a, b in itertools.pairwise(p)))
                    * np.prod([row[t, y] for t, y in enumerate(p)])
                    for p in itertools.product(range(2), repeat=n)
                )
            )
        return total

    for i, j in itertools.product(range(2), repeat=2):
        moved = model.steps.copy()
        moved[i, j] += nudged
        assert (likelihood(moved) - likelihood(model.steps)) / nudged == pytest.approx(steps[i, j], rel=1e-3)


def test_long_words_and_chunks_of_words_agree(monkeypatch):
    model = chain(2)
    words = ["a", "abc" * 5000, "日", "zz"] * 3
    whole = model.evidence(words)
    monkeypatch.setattr(word_chain, "WORDS", 2)
    assert model.evidence(words) == pytest.approx(whole)
    assert whole[0] == pytest.approx(model.evidence(["a"])[0])


def test_fit_without_labels_or_rows():
    none = np.empty((0, 4), int)
    assert fit([], [], none, none).labels == []
    one = fit(["en"], ["a"], np.array([[0, -1]]), np.array([[0, -1]]))
    assert one.evidence(["a"]).tolist() == [[1.0]]


@pytest.fixture(scope="module")
def fitted(spark):
    return fit_languages(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    rows = queries.op13_language(spark, DATA).collect()
    assert len(rows) == len(given)
    langs = {lang for _, lang in given.values()}
    right, held = 0, 0
    for r in rows:
        text, lang = given[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        letters = any(unicodedata.category(c)[0] == "L" for c in text or "")
        assert r.lang_pred in langs if letters else (r.lang_pred, r.score) == ("und", 0)
        if r.held_out and letters:
            held += 1
            right += r.lang_pred == lang
    assert held > 250
    assert right / held >= 0.97


def test_mixed_text_is_labelled_word_by_word(spark, fitted):
    """Halves of held-out documents of two languages, one after the other."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("crc32(cast(doc_id AS string)) % 3 = 1")
    texts = {lang: [] for lang in ("en", "fr", "de", "es")}
    for r in docs.filter("length(text) > 400").orderBy("doc_id").collect():
        texts[r.lang].append(r.text[:300].rsplit(" ", 1)[0])
    pairs = list(zip(texts["en"], texts["fr"] , strict=False)) + list(zip(texts["de"], texts["es"], strict=False))
    mixed = spark.createDataFrame([(k, f"{a} {b}") for k, (a, b) in enumerate(pairs)], "doc_id long, text string")
    good = total = 0
    counts = {k: (a, b) for k, (a, b) in enumerate(pairs)}
    for r in label_words(mixed, fitted).collect():
        a, _ = counts[r.doc_id]
        first = len([w for w in _words(a) if w])
        langs = ("en", "fr") if a in texts["en"] else ("de", "es")
        for k, w in enumerate(r.words):
            total += 1
            good += w.lang == langs[k >= first]
    assert total > 2000
    assert good / total > 0.9
    assert (np.diag(fitted.steps) > fitted.steps.mean()).all()


def _words(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        else:
            words.append(word)
            word = ""
    return words


def test_odd_rows(spark, fitted):
    rows = [(k, t, "old") for k, t in enumerate(ODD)] + [(None, "la le", None), (4, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    docs = docs.withColumn("extra", F.lit(3))
    found = identify_languages(docs, fitted)
    assert sorted(found.columns) == ["doc_id", "extra", "held_out", "lang_pred", "score", "text"]
    got = {r.doc_id: r for r in found.collect()}
    assert [got[k].lang_pred == "und" for k in range(len(ODD))] == [True] * 4 + [False] * 5
    assert got[8].lang_pred == "fr"
    assert not got[None].held_out
    assert identify_languages(docs.limit(0), fitted).collect() == []
    untaught = fit_languages(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {(r.lang_pred, r.score) for r in identify_languages(docs, untaught).collect()} == {("und", 0.0)}
    assert label_words(docs.limit(2), untaught).collect()[0].words == []


def test_sample_is_bounded_and_leaves_out_the_fold(spark):
    rows = [(k, f"w{k} " + "word " * 40, "en" if k % 9 else "fr") for k in range(300)]
    rows += [(1000, None, "en"), (1001, "text", None), (0, rows[0][1], "fr")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_sample(docs, 60).collect()
    assert len(got) <= 61
    assert {r.lang for r in got} == {"en", "fr"}
    keys = {r.key for r in got}
    held = docs.filter("crc32(cast(doc_id AS string)) % 3 = 1").select(F.xxhash64("doc_id", "text").alias("key"))
    assert not keys & {r.key for r in held.collect()}
    assert all(len(p) <= 16 for r in got for p in r.pieces)
