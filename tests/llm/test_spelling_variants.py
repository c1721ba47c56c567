"""Spelling variants against a comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import queries, spelling_variants
from tidemark.llm.spelling_variants import letter_runs
from tidemark.llm.spelling_variants import spelling_variants as variants
from tests.helpers import bag

COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced code point apart, by trying all places."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def expected(words: dict[str, int], ratio: int = 5) -> Counter:
    forms, counts = {}, {}
    for word, n in words.items():
        others = [x for x in words if near(word, x)]
        counts[word] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[word] = best if best and words[best] >= ratio * n else None
    rows = Counter()
    for word, n in words.items():
        root = word
        while forms[root]:
            root = forms[root]
        form = forms[word]
        rows[word, n, counts[word], form, form and words[form], root] += 1
    return rows


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def random_words(draws, letters, count, longest):
    return {
        "".join(draws.choices(letters, k=draws.randint(1, longest))): draws.choice([1, 5, 5, 25, 26, 130])
        for _ in range(count)
    }


@pytest.mark.parametrize("letters", ["ab", "abé日\U0001f600", "abcdefgh"])
def test_equals_all_pairs(spark, letters):
    words = random_words(random.Random(letters), letters, 300, 9)
    assert bag(variants(table(spark, words)), COLUMNS) == expected(words)


def test_large_groups_are_divided(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "GROUP", 8)
    monkeypatch.setattr(spelling_variants, "BLOCK", 4)
    draws = random.Random(5)
    words = {"common" + "".join(draws.choices("abc", k=draws.randint(0, 5))): draws.randint(1, 99) for _ in range(250)}
    assert bag(variants(table(spark, words)), COLUMNS) == expected(words)


def test_blocks_of_one_group(monkeypatch):
    """All pairs of blocks of a group that is larger than a block."""
    import numpy as np

    monkeypatch.setattr(spelling_variants, "BLOCK", 3)
    group = np.array([1, 1, 2, 3, 3, 3, 3, 3, 4])
    pairs = list(spelling_variants._block_pairs(group, np.full(9, 5)))
    met = {(i, j) for a, b in pairs for i in range(a.start, a.stop) for j in range(b.start, b.stop) if i < j}
    assert {(i, j) for i in range(9) for j in range(i + 1, 9) if group[i] == group[j]} <= met


def test_chains_ties_and_odd_rows(spark):
    words = {"aaaaaa": 3125, "aaaaa": 625, "aaaa": 125, "aaa": 25, "aa": 5, "a": 1, "baaa": 125, "x" * 60_000: 50,
             "x" * 60_001: 9}
    given = [*words.items(), ("aa", 2), (None, 9), ("", 9), ("zz", None)]
    rows = spark.createDataFrame(given, "word string, n long").withColumn("n_near", spark.range(1).select("id").scalar())
    found = variants(rows)
    assert bag(found, COLUMNS) == expected(words)
    roots = {r.word: r.root for r in found.collect()}
    assert roots["a"] == "aaaaaa"
    assert roots["x" * 60_001] == "x" * 60_000
    assert variants(rows.limit(0)).collect() == []


def test_endless_forms_are_refused(spark):
    with pytest.raises(ValueError, match="more frequent"):
        variants(table(spark, {"a": 1}), ratio=1)


def test_runs(spark):
    texts = ["Ab3cÉÀé×x ÷", None, "", "日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bag(letter_runs(docs)) == Counter([(0, "ab"), (0, "cÉÀé×x"), (0, "÷")])
    assert bag(letter_runs(docs, 3), ["run"]) == Counter([("cÉÀé×x",)])


def test_query_equals_brute_force(spark, data_dir):
    counts: Counter[str] = Counter()
    for doc in spark.read.parquet(f"{data_dir}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", doc.text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc.doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert len(words) > 500
    assert bag(queries.op11_spelling(spark, data_dir), COLUMNS) == expected(words)
