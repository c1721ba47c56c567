"""Operator 12, phrase collocations from a weighted de Bruijn graph of words.

Nodes are pairs of neighbouring words, edges the triples that lead from one pair to the next,
weighted by how often they occur inside a piece of text. Only the longest grams, the edges,
are counted from the text. What is shorter follows from the flow: a pair occurs as often as
its edges out together and, the correction, as pieces end on it; a word as often as the pairs
that start with it and as pieces end on it. Tasks sum edges and the flow of words over some
millions of places before anything is shuffled, so a frequent word or pair is a row a task.

Edges go to partitions by their node, which gives edges and nodes by one shuffle. The few
nodes that carry much of the flow, told by a sample, are spread by their next word as well;
that decides where rows go and nothing else. Paths are compacted as far as a phrase reaches:
a pair that passes enough of its flow on to one edge, or takes it from one, is part of that
edge's phrase and none of its own, so what remains are the pairs where paths fork.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare_workers, stored

#: Places a task sums up at a time, bytes of text it divides at a time, rows of a batch it gives.
PLACES, TEXT_BYTES, BATCH = 3_000_000, 1 << 20, 1 << 18
#: Bits of a word's number in a packed edge; past so many words, sums are given and numbers start anew.
_BITS, NUMBERS = 21, 1 << 20
_MASK = (1 << _BITS) - 1
#: Rows sampled for heavy nodes, the share of all places that makes one, parts it is spread over.
SAMPLE_ROWS, HEAVY_SHARE, SPREAD = 4_000, 0.001, 64
HEAVY_LENGTH = 200

#: Bytes: A-Z to a-z, what divides pieces to a line feed, all others as they are.
_DIVIDED = bytes(
    10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_ENDS = re.compile(rb"[ \t\n]")
_FLOW = "lang string, node string, next string, size int, n long"


class _Numbers(dict):
    """Words in the order they came, numbered from 1."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


class _Graph:
    """The edges of the texts that a task has read and not yet given."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.walks: dict[str, list[int]] = {}
        self.places = 0

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        """Walk along the pieces of a text; gives what is summed up when enough is."""
        data = text.encode().translate(_DIVIDED)
        low = 0
        while low < len(data):
            # Blocks end where a word does.
            end = _ENDS.search(data, low + TEXT_BYTES)
            high = end.start() if end else len(data)
            self._walk(lang, data[low:high])
            low = high
            if self.places >= PLACES or len(self.numbers) > NUMBERS:
                yield from self.take()
        self.walks.setdefault(lang, []).extend((0, 0))

    def _walk(self, lang: str, block: bytes) -> None:
        walk, number = self.walks.setdefault(lang, []), self.numbers.__getitem__
        for k, piece in enumerate(block.split(b"\n")):
            if k:
                walk.extend((0, 0))
            words = piece.split()
            walk.extend(map(number, words))
            self.places += len(words)

    def take(self) -> Iterator[pa.RecordBatch]:
        """Sums of edges, words and all places so far; the last two words of a walk stay."""
        words = pa.array([b"", *self.numbers], pa.binary()).cast(pa.string())
        listed = list(self.numbers) if len(self.numbers) > NUMBERS // 2 else None
        for lang, walk in self.walks.items():
            steps = np.array(walk, np.int64)
            del walk[:-2]
            first, second, third = steps[:-2], steps[1:-1], steps[2:]
            # Behind the end of a piece comes another one.
            third = np.where(second > 0, third, 0)
            edges = (first << 2 * _BITS | second << _BITS | third)[first > 0]
            edges, counts = np.unique(edges, return_counts=True)
            yield from _rows(lang, words, edges, counts)
        if listed is not None:
            self.numbers = _Numbers()
            for walk in self.walks.values():
                walk[:] = [w and self.numbers[listed[w - 1]] for w in walk]
        self.places = 0


def _rows(lang: str, words: pa.Array, edges: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(edges):
        return
    first = edges >> 2 * _BITS
    starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    flow = np.add.reduceat(counts, starts)
    single = words.take(pa.array(first[starts]))
    yield _batch(lang, pa.array([""]), None, 0, counts.sum(keepdims=True))
    for low in range(0, len(flow), BATCH):
        part = slice(low, low + BATCH)
        yield _batch(lang, single[part], None, 1, flow[part])
    pairs = (edges >> _BITS & _MASK) > 0
    edges, counts = edges[pairs], counts[pairs]
    for low in range(0, len(edges), BATCH):
        part = edges[low : low + BATCH]
        ends = (words.take(pa.array(part >> k & _MASK)) for k in (2 * _BITS, _BITS))
        after = part & _MASK
        following = words.take(pa.array(after, mask=after == 0))
        node = pc.binary_join_element_wise(*ends, " ")
        yield _batch(lang, node, following, 2, counts[low : low + BATCH])


def _batch(lang: str, node: pa.Array, following: pa.Array | None, size: int, n: np.ndarray) -> pa.RecordBatch:
    count = len(n)
    columns = [
        pa.repeat(lang, count),
        node,
        pa.nulls(count, pa.string()) if following is None else following,
        pa.repeat(pa.scalar(size, pa.int32()), count),
        pa.array(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "node", "next", "size", "n"])


def _flow(docs: DataFrame) -> DataFrame:
    """Partial sums ``lang, node, next, size, n``: edges (size 2), words (1), all places (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = _Graph()
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from graph.add(lang, text)
        yield from graph.take()

    prepare_workers(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _FLOW)


def _spread(docs: DataFrame, flow: DataFrame) -> Column:
    """The part of a heavy node that a row belongs to, 0 for all other rows.

    The sample is of some ``SAMPLE_ROWS`` rows, and at most 1 / ``HEAVY_SHARE`` nodes a language
    are heavy. Both bound what the driver learns; which nodes those are changes no result.
    """
    fraction = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sums = _flow(docs.sample(fraction, seed=11)).filter(F.length("node") <= HEAVY_LENGTH)
    sums = sums.groupBy("node", "size").agg(F.sum("n").alias("n"))
    sums = stored(sums, "sampled")
    total = sums.filter("size = 0").agg(F.sum("n")).first()[0] or 0
    heavy = sums.filter((F.col("size") == 2) & (F.col("n") >= max(1.0, HEAVY_SHARE * total)))
    nodes = [r.node for r in heavy.select("node").collect()]
    part = F.pmod(F.xxhash64("next"), F.lit(SPREAD)).cast("int") + 1
    return F.when(F.col("node").isin(nodes), part).otherwise(0) if nodes else F.lit(0)


def phrase_graph(docs: DataFrame, least: int = 10) -> DataFrame:
    """``lang, phrase, size, n``: phrases of one to three words that occur ``least`` times, stored.

    ``size`` is the number of words; size 0, an empty phrase, has all word occurrences of a
    language. See :func:`collocations` for what words and pieces are.
    """
    rows = _flow(docs)
    placed = rows.withColumn("part", _spread(docs, rows)).repartition("lang", "node", "part")
    # Both sums read all columns of the same shuffle, which so is made once.
    ends = F.coalesce(F.sum(F.when(F.col("next").isNull(), F.col("n"))), F.lit(0))
    nodes = placed.groupBy("lang", "node", "size", "part").agg(F.sum("n").alias("n"), ends.alias("ends"))
    nodes = nodes.filter((F.col("n") >= least) | (F.col("part") > 0) | (F.col("size") == 0))
    edges = placed.groupBy("lang", "node", "size", "part", "next").agg(F.sum("n").alias("n"))
    edges = edges.filter(F.col("n") >= least)
    columns = ["lang", "node", "size", "next", "n", "ends", "edge"]
    nodes = nodes.withColumns({"next": F.lit(None).cast("string"), "edge": F.lit(False)})
    edges = edges.withColumns({"ends": F.lit(0).cast("long"), "edge": F.lit(True)})
    both = stored(nodes.select(*columns).union(edges.select(*columns)), "flow")
    summed = both.filter("NOT edge").groupBy("lang", "node", "size").agg(F.sum("n").alias("n"))
    summed = summed.filter((F.col("n") >= least) | (F.col("size") == 0))
    # Ends of pieces and rows of words are no edges.
    triples = both.filter("edge AND size = 2 AND next IS NOT NULL").select(
        "lang", F.concat_ws(" ", "node", "next").alias("phrase"), F.lit(3).alias("size"), "n"
    )
    graph = summed.select("lang", F.col("node").alias("phrase"), "size", "n").union(triples)
    return stored(graph, "phrases")


def collocations(
    docs: DataFrame, *, least: int = 10, percent: int = 50, top: int = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Whole texts of ``docs`` (text, lang) are lower-cased (A-Z), divided into pieces at
    ``.,;:!?`` and U+000A to U+000D, and pieces into words by spaces and tabs. Phrases of two
    or three words that occur ``a >= least`` times within pieces, overlaps included, are
    scored by their weakest cut, floor(1,000,000 a a / (l r)), where ``l`` and ``r`` are the
    occurrences of what is before and behind it, the first of equal cuts. A pair inside a
    triple with at least ``percent`` percent of its occurrences is no phrase of its own.
    ``rank`` is by score, ``a`` (both falling) and phrase (by its UTF-8 bytes); ``n`` counts
    the language's words.

    A null lang counts as ``und``, null and empty texts have no words, repeated rows count
    as often as they stand there, and a table without rows or frequent phrases gives no
    rows. Other columns are ignored. Very long texts are walked in blocks. The arithmetic is
    decimal with 38 digits.
    """
    graph = phrase_graph(docs, least)
    words = F.split("phrase", " ")
    phrases = graph.filter("size >= 2").select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    cuts = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", "a", "words", cuts)
    cuts = cuts.select(
        *("lang", "phrase", "a", "cut"),
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("right"),
    )
    # The parts of a frequent phrase are at least as frequent, so none is missing.
    for side, count in (("left", "l"), ("right", "r")):
        known = graph.filter("size > 0").select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        cuts = cuts.join(known, ["lang", side])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.call_function("div", exact["a"] * exact["a"] * F.lit(1_000_000), exact["l"] * exact["r"])
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("weakest")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest)
    inside = phrases.filter(F.size("words") == 3).select(
        "lang",
        F.explode(F.array(*(F.array_join(F.slice("words", k, 2), " ") for k in (1, 2)))).alias("phrase"),
        "a",
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    own = scored.join(inside, ["lang", "phrase"], "left").filter(
        F.col("_around").isNull() | (100 * F.col("_around") < percent * F.col("a"))
    )
    total = graph.filter("size = 0").select("lang", "n")
    return _ranked(own, top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    flat = scored.select("lang", "phrase", "a", "weakest.score", "weakest.l", "weakest.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark keeps each task's first rows only before it shuffles.
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
