"""The pipeline: stages in order, columns, and what each must keep and drop."""

from __future__ import annotations

import zlib

import corpus_pipeline
from tidemark.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score int, n_hit string, _own_0 string, digest int"


def test_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_the_last_ones_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name in ("toxicity", "quality"):
            module = {"toxicity": toxicity, "quality": quality}[name]
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            model = getattr(module, f"fit_{name}")(docs, labels)
            scored = getattr(module, f"score_{name}")(docs, model).collect()
            want = {r.doc_id for r in scored if r.predicted == (name == "quality")}
            assert {r.doc_id for r in kept.select("doc_id").collect()} == want
        assert {r.doc_id for r in kept.select("doc_id").collect()} < ids
        docs = corpus_pipeline.stored(kept, name)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    left = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == set(left)
    ends = {}
    for r in packed:
        ends[r.doc_id] = max(ends.get(r.doc_id, 0), r.start + r.length)
    assert all(end <= len((left[k] or "").encode()) + 1 for k, end in ends.items())


def test_near_duplicates_and_benchmark_go_clean_rows_stay(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    prose = [" ".join(f"{w}{k}" for w in "abcdefghijklmnopqrstuvwxyz") for k in range(6)]
    texts = [*prose, prose[0], prose[1] + " z", f"Before. {item} After.", None, "", None]
    rows = [(k, t, "en", k, "h", "own", 3) for k, t in enumerate(texts)] + [(0, texts[0], "en", 0, "h", "own", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert unique.columns == docs.columns
    assert sorted(r.doc_id for r in unique.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]
    clean = corpus_pipeline.drop_contaminated(spark, unique, DATA)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 3, 4, 5, 9, 10, 11]
    assert all(r.n_hit == "h" and r._own_0 == "own" and r.digest == 3 for r in clean.collect())


def test_stages_take_odd_and_no_rows(spark):
    rows = [(k, t, None, None, None, None, None) for k, t in enumerate([None, "", "x " * 200_000])]
    docs = spark.createDataFrame([*rows, (None, "text", *[None] * 5)], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).collect()
        assert stage(spark, docs.limit(0), DATA).collect() == []


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    flipped = [
        (r.doc_id, r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 else 1 - r.quality)
        for r in labels
    ]
    given = spark.createDataFrame([(r.doc_id, r.quality) for r in labels], "doc_id long, quality int")
    changed = spark.createDataFrame(flipped, "doc_id long, quality int")
    one, other = (quality.fit_quality(docs, x) for x in (given, changed))
    assert [t.tolist() for t in one.tables] == [t.tolist() for t in other.tables]
