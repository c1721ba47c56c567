"""Operator 5, benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words. Any window of ten consecutive item words
holds one of the item's aligned five-word blocks whole, so the automaton's patterns are
those blocks and, for shorter items, the whole item. It scans every document once; where
a block occurs, the match is extended word by word to both sides, and runs of at least a
window are hit. So the automaton is no larger than the items' text, and matches are exact.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import arrow_map, other_columns_aside, prepare_workers, stored

WINDOW = 10
#: Bytes of items' text and ids in one automaton; more items make more automatons and passes.
AUTOMATON_BYTES = 2 << 20
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes: A-Z to a-z, all other ASCII but digits and a-z to a space, UTF-8's others as they are.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
SPANS = "array<struct<start:long,end:long>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Matcher:
    """Finds windows of the given items; items are (ids, words)."""

    def __init__(self, items: list[tuple[list[str], list[bytes]]], window: int):
        import ahocorasick

        self.items, self.window = items, window
        self.automaton = ahocorasick.Automaton()
        block = (window + 1) // 2
        places = defaultdict(list)
        for k, (_, words) in enumerate(items):
            if len(words) < window:
                places[b" ".join(words)].append((k, 0))
            else:
                for at in range(0, len(words) - block + 1, block):
                    places[b" ".join(words[at : at + block])].append((k, at))
        for pattern, where in places.items():
            # Latin-1 keeps one character per byte.
            spaced = f" {pattern.decode('latin-1')} "
            self.automaton.add_word(spaced, (len(spaced), pattern.count(b" ") + 1, where))
        if places:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged runs of hit words, from and to, and the items that occur."""
        runs: set[tuple[int, int]] = set()
        occurring: set[int] = set()
        if not words or not len(self.automaton):
            return [], occurring
        line = f" {b' '.join(words).decode('latin-1')} "
        starts: list[int] = []
        covered: dict[tuple[int, int], int] = {}
        for end, (size, length, where) in self.automaton.iter(line):
            if not starts:
                for word in words:
                    starts.append(starts[-1] + before + 1 if starts else 1)
                    before = len(word)
            first = bisect_right(starts, end - size + 2) - 1
            for item, at in where:
                own = self.items[item][1]
                shift = first - at
                # A run of this item on this diagonal that was extended over this block before.
                if covered.get((item, shift), -1) >= first + length:
                    continue
                low, high = first, first + length
                if len(own) >= self.window:
                    while low > 0 and low > shift and words[low - 1] == own[low - 1 - shift]:
                        low -= 1
                    stop = min(len(words), shift + len(own))
                    while high < stop and words[high] == own[high - shift]:
                        high += 1
                covered[item, shift] = high
                if high - low >= min(self.window, len(own)):
                    runs.add((low, high))
                    occurring.add(item)
        return _united(list(runs)), occurring


def _item_classes(benchmark: DataFrame) -> DataFrame:
    """Items with the same words as one row: words joined by spaces, and all their ids."""
    schema = StructType.fromDDL("item_id string, words string")

    def normal(batch: pa.RecordBatch) -> dict[str, list]:
        ids, texts = (batch.column(k).to_pylist() for k in (0, 1))
        return {"item_id": ids, "words": [b" ".join(words_of(t)).decode() for t in texts]}

    items = benchmark.select(F.col("item_id").cast("string"), "text").dropna()
    words = arrow_map(items, normal, schema).filter("words <> ''")
    return words.groupBy("words").agg(F.collect_set("item_id").alias("ids"))


@other_columns_aside("text")
def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, item_ids, spans, contaminated``.

    A word of a document is hit if it lies in an occurrence of ``window`` consecutive
    words of an item's text; an item with fewer words, but not none, is one window.
    ``item_ids`` are the occurring items' ids as sorted strings, ``spans`` the hit runs as
    offsets (code points) into the original text, ``contaminated`` holds if any word is
    hit. Null and empty texts have no words. Items with null id or text, or without
    words, take no part; without items nothing is hit. Columns called like the added ones
    are replaced, other columns and repeated rows stay.

    Texts are scanned whole, however long; equal texts get equal results.

    The automaton holds at most ``automaton_bytes`` of item text; up to there one pass
    without a shuffle does it. A larger benchmark is split into such parts by hash, and
    each part reads the texts once and stores its hits only. Hits are kept once for each
    different text, by its SHA-256, and joined to the documents in the end: without a
    shuffle of documents if Spark finds the stored hits small enough to broadcast.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "spans", "contaminated")
    classes = stored(_item_classes(benchmark), "items")
    ids_size = F.aggregate("ids", F.lit(0), lambda n, i: n + F.octet_length(i))
    size = classes.agg(F.sum(F.octet_length("words") + ids_size)).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    if parts == 1:
        return _scanned(docs, _items(classes), window)
    part_of = F.pmod(F.xxhash64("words"), F.lit(parts))
    hits = [
        stored(_hits(docs, _items(classes.filter(part_of == part)), window), "hits")
        for part in range(parts)
    ]
    # At most one row of a text from each part.
    by_text = reduce(DataFrame.unionAll, (h.dropDuplicates(["_key"]) for h in hits)).groupBy("_key")
    lists = (F.flatten(F.collect_list(c)).alias(c) for c in ("_runs", "_items"))
    known = stored(by_text.agg(*lists), "hits")
    joined = docs.withColumn("_key", F.sha2("text", 256)).join(known, "_key", "left").drop("_key")
    return _mapped(joined, docs.columns, lambda: _earlier_hits)


def _items(classes: DataFrame) -> list[tuple[list[str], list[bytes]]]:
    return [(list(r.ids), r.words.encode().split()) for r in classes.collect()]


def _earlier_hits(words: list[bytes], batch: pa.RecordBatch, k: int) -> tuple[list, set]:
    runs, ids = (batch.column(n)[k].as_py() or [] for n in ("_runs", "_items"))
    return _united([(r["start"], r["end"]) for r in runs]), set(ids)


def _searching(docs: DataFrame, items: list, window: int) -> Callable[[], Callable]:
    """What tasks search with: an automaton of these items, from a broadcast."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def start() -> Callable[[list[bytes], pa.RecordBatch, int], tuple[list, set]]:
        matcher = _matcher(name, shared.value, window)

        def search(words: list[bytes], batch: pa.RecordBatch, k: int) -> tuple[list, set]:
            runs, occurring = matcher.find(words)
            return runs, {i for item in occurring for i in matcher.items[item][0]}

        return search

    return start


def _scanned(docs: DataFrame, items: list, window: int) -> DataFrame:
    """One pass over the documents with one automaton."""
    return _mapped(docs, docs.columns, _searching(docs, items, window))


def _mapped(rows: DataFrame, kept: list[str], start: Callable[[], Callable]) -> DataFrame:
    """``kept`` of ``rows`` and the added columns, from the runs and ids that a search gives."""
    added = f"n_words long, n_hit long, item_ids array<string>, spans {SPANS}, contaminated boolean"
    new = StructType.fromDDL(added)
    schema = StructType([rows.schema[c] for c in kept] + new.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        search, kinds = start(), to_arrow_schema(new)
        for batch in batches:
            results: list[list] = [[] for _ in kinds]
            texts = batch.column("text")
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                words = words_of(text)
                runs, ids = search(words, batch, k)
                n_hit = sum(b - a for a, b in runs)
                row = (len(words), n_hit, sorted(ids), _offsets(text, runs), n_hit > 0)
                for values, value in zip(results, row, strict=True):
                    values.append(value)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(v, f.type) for v, f in zip(results, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    prepare_workers(rows.sparkSession)
    return rows.mapInArrow(scan, schema)


def _hits(docs: DataFrame, items: list, window: int) -> DataFrame:
    """``_key, _runs, _items`` of the texts that hold any of these items, and of no other."""
    schema = StructType.fromDDL(f"_key string, _runs {SPANS}, _items array<string>")
    start = _searching(docs, items, window)

    def find(batch: pa.RecordBatch) -> dict[str, list]:
        search = start()
        rows = []
        for k, text in enumerate(batch.column(0).to_pylist()):
            runs, ids = search(words_of(text), batch, k)
            if runs:
                key = hashlib.sha256(text.encode()).hexdigest()
                rows.append((key, [{"start": a, "end": b} for a, b in runs], sorted(ids)))
        return {n: [r[k] for r in rows] for k, n in enumerate(schema.names)}

    return arrow_map(docs.select("text").filter("text <> ''"), find, schema)


_MATCHERS: dict[str, Matcher] = {}


def _matcher(name: str, items: list, window: int) -> Matcher:
    """The automaton of one pass; a worker keeps the last one."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(items, window)
    return _MATCHERS[name]


def _united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if merged and low <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    return merged


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as offsets into the original text."""
    if not runs:
        return []
    folded = text.translate({c: c + 32 for c in range(65, 91)})
    places = [m.span() for m in WORD.finditer(folded)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs]
