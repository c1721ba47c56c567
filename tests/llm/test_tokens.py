"""Token counts and packing against the libraries themselves."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import packing, queries
from tidemark.llm.packing import OpenBins, pack, pack_documents, sequences
from tidemark.llm.token_count import count_tokens, transducer
from tidemark.llm.token_transducer import SLICE

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, length int"
ODD = [
    "",
    " ",
    "   ",
    "▁▁ ▁",
    "<s>hi</s> <unk> <0x0A>",
    "a\x00b\r\n\tc",
    "日本語 ①② \U0001f600\u0301",
    "x" * 3000,
    " " * 3000,
    "\n" * 300,
    "<|endoftext|> and <|endoftext|>",
    "it's  we'LL 123456 \u00a0\u3000.",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_of_odd_and_random_texts(model):
    chance = random.Random(5)
    pieces = [model.id_to_piece(k) for k in range(259, 32000)]
    letters = "abcdeé  ▁\n日①<>0x1 the"
    texts = ODD + ["".join(chance.choices(letters, k=chance.randint(0, 900))) for _ in range(300)]
    texts += ["".join(chance.choices(pieces, k=200)) for _ in range(100)]
    texts += ["".join(chance.choices("aeinorst", k=3000)) for _ in range(10)]
    assert transducer(MODEL).count(texts) == [len(x) for x in model.encode(texts)]


def test_counts_of_texts_longer_than_a_slice(model):
    chance = random.Random(6)
    with_words = "".join(chance.choices("etaoin ", k=SLICE + 5000))
    one_word = "".join(chance.choices("eta", k=SLICE + 999))
    found = transducer(MODEL).count([with_words, "x", one_word])
    assert found == [len(x) for x in model.encode([with_words, "x", one_word])]


def test_a_small_table_starts_anew_and_grows(model):
    from tidemark.llm.token_transducer import Transducer, Vocabulary

    scores = {
        model.id_to_piece(k): model.get_score(k)
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))
    }
    small = Transducer(Vocabulary.from_scores(scores), slots=64)
    chance = random.Random(7)
    for _ in range(3):
        texts = ["".join(chance.choices("abcdefgh ", k=400)) for _ in range(5)]
        assert small.count(texts) == [len(x) for x in model.encode(texts)]


def test_count_operator(spark, model):
    rows = [(k, t, 5) for k, t in enumerate([*ODD, None])] + [(None, "a b", 1), (0, "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("length", "n_tokens")
    found = count_tokens(docs, MODEL, limit=3).collect()
    assert len(found) == len(rows)
    for r in found:
        tokens = len(model.encode(r.text or ""))
        assert (r.n_tokens, r.over_limit) == (tokens, tokens > 3)
        assert r.n_bytes == len((r.text or "").encode())
    assert count_tokens(docs.limit(0), MODEL).collect() == []


def test_count_query(spark, data_dir, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    found = queries.op8_token_count(spark, data_dir).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {
        k: len(model.encode(t or "")) for k, t in texts.items()
    }


def ids_of(text):
    exact = Tokenizer.from_file(BPE)
    return np.array(exact.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = ids_of(text), 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.length == capacity or k == 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
        assert len(by_doc[doc]) == -(-len(ids) // capacity)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pack_query(spark, data_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = queries.op4_pack(spark, data_dir).collect()
    used = check_packing(rows, texts, 2048)
    assert used <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_pack_operator(spark):
    texts = dict(enumerate([*ODD, None, "word " * 500, "ab " * 63, "ab " * 64]))
    rows = [(k, t, 9) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, DOCS)
    # Without ranks and with them.
    ranks = {
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }
    for more in ({}, ranks):
        packed = pack_documents(docs, BPE, capacity=64, **more)
        check_packing(packed.collect(), texts, 64)
    joined = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(packed).collect()}
    for r in packed.collect():
        own = ids_of(texts[r.doc_id])[r.start : r.start + r.length]
        assert (joined[r.sequence_id][r.offset : r.offset + r.length] == own).all()
    assert pack_documents(docs.limit(0), BPE).collect() == []


def test_pack_over_tasks_null_ids_and_repeats(spark):
    pieces = spark.createDataFrame(
        [(None, 0, 1 + k % 10, 3) for k in range(500)], "doc_id long, piece int, length long, offset int"
    )
    rows = pack(pieces, capacity=10, task_sequences=50).collect()
    assert len(rows) == 500
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 10 for p in places.values())
    assert len({s >> 40 for s in places}) == 6
    with pytest.raises(ValueError, match="1 pieces"):
        pack(spark.createDataFrame([(1, 0, 11)], "doc_id long, piece int, length long"), capacity=10)


def test_bins_are_bounded_and_best_fit():
    bins = OpenBins(10, limit=2, first=0)
    assert bins.place(6) == (0, 0)
    assert bins.place(5) == (1, 0)
    assert bins.place(4) == (0, 6)  # fits bin 0 exactly
    assert bins.place(7) == (2, 0)
    assert bins.place(9) == (3, 0)  # the fullest, bin 2, closes first
    assert bins.place(5) == (1, 5)
    assert bins.place(1) == (3, 9)
    assert (bins.open, bins.free) == (0, 0)


def test_bins_close_for_the_bound_at_production_settings():
    draws = np.random.Generator(np.random.PCG64(8))
    lengths = draws.integers(200, 1400, size=40_000)
    # As many pieces as one task gets, longest first.
    lengths = np.sort(lengths[np.cumsum(lengths) <= packing.TASK_SEQUENCES * packing.CAPACITY])[::-1]
    peaks = []
    for limit in (1 << 20, packing.OPEN_BINS):
        bins, most = packing.OpenBins(packing.CAPACITY, limit, 0), 0
        for length in lengths.tolist():
            bins.place(length)
            most = max(most, bins.open)
        peaks.append(most)
    assert peaks[0] > packing.OPEN_BINS
    assert peaks[1] == packing.OPEN_BINS
