"""Phrases against counts of all grams; the whole query is tested against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import collocations as module
from tidemark.llm.collocations import collocations, phrase_graph
from tests.helpers import bag, plan

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def grams(docs):
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in docs:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]", piece) if w]
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    counts["und" if lang is None else lang][tuple(words[k : k + size])] += 1
    return counts


def expected(docs, least=10, percent=50, top=2000):
    rows = []
    for lang, counts in grams(docs).items():
        frequent = {g: f for g, f in counts.items() if len(g) > 1 and f >= least}
        found = []
        for gram, a in frequent.items():
            if any(
                100 * f >= percent * a
                for longer, f in frequent.items()
                if len(longer) > len(gram) and gram in (longer[:-1], longer[1:])
            ):
                continue
            cuts = [
                (1_000_000 * a * a // (counts[gram[:k]] * counts[gram[k:]]), k) for k in range(1, len(gram))
            ]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(gram).encode(), counts[gram[:k]], counts[gram[k:]]))
        n = sum(f for g, f in counts.items() if len(g) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return Counter(rows)


def table(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string")


def random_docs(draws, count=150):
    words = ["a", "B", "c", "É", "é", "日本", "x y", "-"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]
    texts = ["".join(draws.choice(words) + draws.choice(marks) for _ in range(draws.randint(0, 40))) for _ in range(count)]
    return [(t, draws.choice(["en", "de", None])) for t in texts]


@pytest.fixture
def docs():
    return [*random_docs(random.Random(7)), (None, "en"), ("", "de"), ("...", "en"), ("one", None)]


def test_equals_all_grams(spark, docs):
    for least, percent, top in ((10, 50, 2000), (3, 80, 5)):
        found = collocations(table(spark, docs), least=least, percent=percent, top=top)
        assert bag(found, COLUMNS) == expected(docs, least, percent, top)


def test_small_steps_and_heavy_nodes_change_nothing(spark, docs, monkeypatch):
    """Flushes in the middle of pieces, tiny blocks of text, and every node spread."""
    graph = module._Graph
    found = Counter()
    monkeypatch.setattr(module, "PLACES", 7)
    monkeypatch.setattr(module, "TEXT_BYTES", 5)
    monkeypatch.setattr(module, "NUMBERS", 6)
    walked = graph()
    batches = [b for text, lang in docs for b in walked.add(lang or "und", text or "")]
    for batch in [*batches, *walked.take()]:
        for r in batch.to_pylist():
            found[r["lang"], r["node"], r["next"], r["size"]] += r["n"]
    monkeypatch.undo()
    words = Counter()
    for lang, counts in grams(docs).items():
        for gram, f in counts.items():
            if len(gram) == 1:
                words[lang, gram[0], None, 1] += f
                words[lang, "", None, 0] += f
            if len(gram) == 3:
                words[lang, " ".join(gram[:2]), gram[2], 2] += f
    ends = {k: n for k, n in found.items() if k[3] == 2 and k[2] is None}
    assert Counter({k: n for k, n in found.items() if k not in ends}) == words
    monkeypatch.setattr(module, "HEAVY_SHARE", 1e-9)
    assert bag(collocations(table(spark, docs)), COLUMNS) == expected(docs)


def test_flow_gives_all_shorter_counts(spark, docs):
    counts = {
        (lang, " ".join(g)): f for lang, c in grams(docs).items() for g, f in c.items() if f >= 4
    }
    found = {(r.lang, r.phrase): r.n for r in phrase_graph(table(spark, docs), 4).collect() if r["size"]}
    assert found == counts


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits, and a floor that a double would miss."""
    rows = [("en", "p q", 2, 4_000_000_000_000), ("en", "p", 1, 4_000_000_000_001), ("en", "q", 1, 4_000_000_000_003),
            ("en", "", 0, 9_000_000_000_000)]
    graph = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(module, "phrase_graph", lambda docs, least: graph)
        (found,) = collocations(table(spark, [])).collect()
    a, left, right = 4_000_000_000_000, 4_000_000_000_001, 4_000_000_000_003
    assert found.score == 1_000_000 * a * a // (left * right)


def test_empty_and_other_columns(spark):
    empty = table(spark, [("a b", "en")]).limit(0)
    assert collocations(empty).collect() == []
    rows = spark.createDataFrame([("a b " * 12, "en", 1, 2)], "text string, lang string, node long, part long")
    assert bag(collocations(rows), COLUMNS) == expected([("a b " * 12, "en")])


def test_one_shuffle_gives_edges_and_nodes(spark, data_dir, monkeypatch):
    """Both sums of the graph read the same exchange."""
    seen = []
    monkeypatch.setattr(module, "stored", lambda rows, purpose: (seen.append((purpose, rows)), rows)[1])
    phrase_graph(spark.read.parquet(f"{data_dir}/documents.parquet"))
    flow = next(rows for purpose, rows in seen if purpose == "flow")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "ReusedExchange" in plan(flow)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
