"""Decontamination against a scan window by window."""

from __future__ import annotations

import random
import re

from tidemark.llm import decontaminate
from tidemark.llm.common import stored
from tidemark.llm.decontaminate import find_contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n_words string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    doc, hit, ids = words(text), set(), set()
    for item_id, item in items:
        own = words(item)
        if item_id is None or item is None or not own:
            continue
        size = min(window, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(doc) - size + 1):
            if tuple(doc[k : k + size]) in grams:
                ids.add(str(item_id))
                hit.update(range(k, k + size))
    return len(doc), len(hit), sorted(ids), bool(hit)


def compare(spark, texts, items, **settings):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = find_contamination(docs, benchmark, **settings).collect()
    assert len(rows) == len(texts)
    window = settings.get("window", 10)
    for r in rows:
        found = (r.n_words, r.n_hit, r.item_ids, r.contaminated)
        assert found == brute(r.text, items, window), r.text
        covered = [w for s in r.spans for w in words(r.text[s.start : s.end])]
        assert len(covered) == r.n_hit
    return rows


def test_random_texts_in_any_window(spark):
    chance = random.Random(2)
    letters = ["a", "B", "é", "c1", "-", "."]

    def text(n):
        return " ".join(chance.choices(letters, k=n))

    for window in (1, 2, 3, 5, 10):
        items = [(k, text(chance.randint(0, 25))) for k in range(12)]
        texts = [text(chance.randint(0, 60)) for _ in range(40)]
        texts += [f"{text(5)} {items[k][1]} {text(5)}" for k in range(12)]
        compare(spark, texts, items, window=window)


def test_many_automatons_find_the_same(spark):
    chance = random.Random(4)
    items = [(k, " ".join(chance.choices("abcd", k=14))) for k in range(10)]
    texts = [" ".join(chance.choices("abcd", k=80)) for _ in range(10)] + [t for _, t in items]
    compare(spark, texts, items, automaton_bytes=64, window=4)


def test_large_benchmark_stores_hits_only(spark, monkeypatch):
    chance = random.Random(6)
    vocabulary = [f"w{k}" for k in range(5_000)]
    items = [(k, " ".join(chance.choices(vocabulary, k=30))) for k in range(300)]
    texts = [" ".join(chance.choices(vocabulary, k=300)) for _ in range(60)]
    # Copies of one hit text, which is hit by items of several automatons.
    texts += [None, "", *[" ".join(t for _, t in items[:40])] * 20]
    rows = []

    def counted(found, purpose):
        kept = stored(found, purpose)
        if purpose == "hits":
            rows.append(kept.count())
            assert "text" not in kept.columns
        return kept

    monkeypatch.setattr(decontaminate, "stored", counted)
    compare(spark, texts, items, automaton_bytes=8_000)
    assert len(rows) > 5
    assert rows[-1] == 1
    assert max(rows[:-1]) == 20


def test_odd_rows(spark):
    passage = "One TWO three, four; five six seven eight nine ten eleven"
    items = [(1, passage), (2, passage), (2, passage), (11, "short item"), (None, "w"), (5, None), (6, "..")]
    texts = [
        None,
        "",
        "...",
        passage.upper(),
        passage[4:],
        "x" + passage,
        "a short item. short ITEM",
        "filler " * 50_000 + passage + " filler" * 50_000,
        passage,
        passage,
    ]
    rows = compare(spark, texts, items)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].item_ids == ["1", "2"]
    assert by_id[7].text[by_id[7].spans[0].start : by_id[7].spans[0].end] == passage


def test_empty_tables(spark):
    rows = compare(spark, ["a b", None], [])
    assert [r.n_hit for r in rows] == [0, 0]
    compare(spark, [], [(1, "a")])
