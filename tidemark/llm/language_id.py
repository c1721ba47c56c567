"""Operator 13, language identification: a conditional random field labels every word.

The field learns from documents' languages. Its sequences are spliced from pieces of
different documents, so that transitions between languages are learned as well, and words of
mixed texts are labelled one by one. A document's language is the one that its words' chances
add up to most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import arrow_map, stored
from tidemark.llm.labelled import fold
from tidemark.llm.word_chain import WordChain, fit

FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"
#: Documents that are learned from at most, in all and of one language; pieces of each, words of a piece.
SAMPLE_ROWS, LANGUAGE_ROWS, PIECES, PIECE = 8_000, 2_000, 2, 16
#: Longer words are not learned from. They are labelled like all others.
LONGEST = 100
NOT_LETTERS = r"\PL+"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, lower-cased runs of letters, and how many each text has."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), pattern=NOT_LETTERS)
    words = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    counts = np.bincount(owner.filter(some).to_numpy(), minlength=len(texts))
    return words.filter(some), counts.astype(np.int64)


def _known(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def language_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``lang, pieces`` of the documents that are learned from: outside the fold, of known language.

    At most ``LANGUAGE_ROWS`` of a language and about ``rows`` in all, in the order of a hash
    of id and text. A piece is some ``PIECE`` words, at even distances in the whole text.
    """
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    given = docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    given = given.select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("key"), "text"
    )
    keys = given.select("lang", "key").distinct()
    languages = keys.select("lang").distinct().count()
    most = min(LANGUAGE_ROWS, -(-rows // max(1, languages)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = stored(keys.withColumn("nth", nth).filter(F.col("nth") <= most).select("lang", "key"), "chosen")
    # At most about ``rows`` short rows.
    texts = given.join(F.broadcast(chosen), ["lang", "key"]).dropDuplicates(["lang", "key"])
    schema = StructType.fromDDL("lang string, key long, pieces array<array<string>>")

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        words, counts = _words(batch.column(2))
        listed, low, pieces = words.to_pylist(), 0, []
        for count in counts:
            own = [w for w in listed[low : low + count] if len(w) <= LONGEST]
            starts = np.unique(np.linspace(0, max(0, len(own) - PIECE), PIECES).astype(int))
            pieces.append([own[s : s + PIECE] for s in starts if own])
            low += count
        return {"lang": batch.column(0), "key": batch.column(1), "pieces": pieces}

    return stored(arrow_map(texts.select("lang", "key", "text"), cut, schema), "sample")


def fit_languages(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> WordChain:
    """The field fitted on at most about ``sample_rows`` of ``docs`` (doc_id, text, lang).

    Learns from texts and languages outside the held-out fold alone. The driver gets a few
    words of each sampled document, and the result doesn't depend on the order of rows.
    Without any language the field has no labels.
    """
    rows = language_sample(docs, sample_rows).orderBy("key", "lang").collect()
    labels = sorted({r.lang for r in rows})
    number = {label: k for k, label in enumerate(labels)}
    pieces = [(number[r.lang], p) for r in rows for p in r.pieces]
    # First all first pieces, so that neighbours are of different documents.
    ordered = sorted(range(len(pieces)), key=lambda k: (k % PIECES, k))
    pieces = [pieces[k] for k in ordered]
    known = {w: k for k, w in enumerate(sorted({w for _, p in pieces for w in p}))}
    joined = [pieces[k : k + 2] for k in range(0, len(pieces), 2)]
    ids, marks = (np.full((len(joined), 2 * PIECE), -1) for _ in range(2))
    for row, two in enumerate(joined):
        words = [(known[w], label) for label, piece in two for w in piece]
        ids[row, : len(words)] = [w for w, _ in words]
        marks[row, : len(words)] = [m for _, m in words]
    return fit(labels, list(known), ids, marks)


def _labelled(model: WordChain, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of texts, how many each has, places among them, and the labels' chances there."""
    if not model.labels:
        return
    words, sizes = _words(texts)
    encoded = words.dictionary_encode()
    evidence = model.evidence(encoded.dictionary.to_pylist())
    numbers = encoded.indices.to_numpy()
    for places, chances in model.marginals(numbers, sizes, evidence):
        yield words, sizes, places, chances


def identify_languages(docs: DataFrame, model: WordChain) -> DataFrame:
    """``docs`` plus ``held_out, lang_pred, score``, from each whole ``text`` alone.

    ``lang_pred`` is the language with the largest sum of chances over the text's words
    (ties: the first by name), ``score`` its share of all words. A null text, one without
    letters, and every text where no language was learned, is ``und`` with a score of 0. A
    word is a run of letters of any length, lower-cased. ``held_out`` marks the fold that is
    never learned from, false for a null id. Columns called like the added ones are
    replaced; all others, and repeated rows, stay. One map-only pass; long texts are worked
    on in chunks whose sums join them exactly.
    """
    added = ("held_out", "lang_pred", "score")
    kept = docs.select([c for c in docs.columns if c not in added])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    names = kept.columns
    text = names.index("text")

    def predict(batch: pa.RecordBatch) -> dict[str, list]:
        sums = np.zeros((batch.num_rows, len(model.labels)))
        for _, sizes, places, chances in _labelled(model, _known(batch.column(text))):
            owner = np.searchsorted(np.cumsum(sizes), places, "right")
            for k in range(len(model.labels)):
                sums[:, k] += np.bincount(owner, chances[:, k], batch.num_rows)
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1) if model.labels else np.zeros(batch.num_rows, int)
        share = sums.max(axis=1, initial=0) / np.where(total > 0, total, 1)
        langs = [model.labels[k] if t > 0 else UNKNOWN for k, t in zip(best, total, strict=True)]
        columns = dict(zip(names, batch.columns, strict=True))
        return columns | {"lang_pred": langs, "score": np.minimum(share, 1).tolist()}

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return arrow_map(kept, predict, schema).withColumn("held_out", held)


def label_words(docs: DataFrame, model: WordChain) -> DataFrame:
    """``doc_id, words``: every word of each text with its likeliest language and that one's chance.

    Texts without words have an empty array, and so has every text where no language was learned.
    """
    ids = docs.schema["doc_id"]
    words = StructType.fromDDL("words array<struct<word: string, lang: string, score: double>>")
    schema = StructType([StructField("doc_id", ids.dataType), *words.fields])

    def label(batch: pa.RecordBatch) -> dict[str, list]:
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for given, sizes, places, chances in _labelled(model, _known(batch.column(1))):
            owner = np.searchsorted(np.cumsum(sizes), places, "right").tolist()
            texts = given.take(pa.array(places)).to_pylist()
            best, share = chances.argmax(axis=1).tolist(), chances.max(axis=1).tolist()
            for o, w, b, s in zip(owner, texts, best, share, strict=True):
                found[o].append({"word": w, "lang": model.labels[b], "score": s})
        return {"doc_id": batch.column(0), "words": found}

    return arrow_map(docs.select("doc_id", "text"), label, schema)
