"""Operator 4, best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best fit: every task keeps a fixed number of open bins in a bitset
keyed by free space. A piece goes into the bin it fills best; where none has room a new
one opens, and if all are open the fullest closes first. Pieces arrive longest first,
so that short ones fill what long ones leave.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemark.llm.common import prepare_workers, stored

CAPACITY = 2048
#: Open bins of a task. Without the bound some 7,000 of 16,384 sequences are open at once;
#: the bound costs about one sequence in a thousand.
OPEN_BINS = 6_144
#: Sequences that one task fills.
TASK_SEQUENCES = 1 << 14
END_ID = 0


class Encoder:
    """Ids of a byte-level BPE file, by the faster of two libraries that give the same ids."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                pairs = (line.split() for line in lines)
                ranks = {base64.b64decode(a): int(b) for a, b in pairs}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=1)
def _encoder(path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks_path, pattern)


def tokenised_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    columns: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Per document its pieces: ``columns``, ``piece, start, length, ids, ids_crc32``.

    A document is the ids of its whole ``text`` (null: empty) and one end id. Only longer
    ones than ``capacity`` are cut, so that all pieces but the first are full. ``ids`` is
    little-endian unsigned 32-bit, null without ``keep_ids``. ``ranks_path`` and
    ``pattern`` name the same vocabulary as ranks; texts with strings of special tokens
    are left to the tokenizer file, whose default makes one id of them.
    """
    given = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    added = "piece int, start long, length long, ids binary, ids_crc32 long"
    schema = StructType(given.schema.fields[:-1] + StructType.fromDDL(added).fields)
    end = np.array([END_ID], np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                ids = np.concatenate([encoder.ids(text.as_py()), end])
                first = (len(ids) - 1) % capacity + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    raw = ids[start:stop].tobytes()
                    kept = raw if keep_ids else None
                    rows.append((k, piece, start, stop - start, kept, zlib.crc32(raw)))
            source, piece, start, length, ids_, crc = zip(*rows, strict=True) if rows else [()] * 6
            own = batch.select(batch.schema.names[:-1]).take(pa.array(source, pa.int64()))
            new = [
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(ids_, pa.binary()),
                pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*own.columns, *new], names=schema.names)

    prepare_workers(docs.sparkSession)
    return given.mapInArrow(cut, schema)


class OpenBins:
    """At most ``limit`` open bins; bit f of ``free`` is set if some bin has f places left."""

    def __init__(self, capacity: int, limit: int, first: int):
        self.capacity, self.limit, self.following = capacity, limit, first
        self.free, self.open = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        taken = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset of a piece."""
        room = self.free >> length
        if room:
            space = length + (room & -room).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, chosen = self.capacity, self.following
            self.following += 1
        left = space - length
        if left:
            self.bins[left].append(chosen)
            self.free |= 1 << left
            self.open += 1
        return chosen, self.capacity - space


def pack(
    pieces: DataFrame,
    *,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    task_sequences: int = TASK_SEQUENCES,
    order: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """``pieces`` (a ``length`` and any other columns) plus ``sequence_id`` and ``offset``.

    Sequences hold at most ``capacity`` places and are gapless from 0. Rows are dealt out
    evenly to as many tasks as ``task_sequences`` sequences each need, whatever their
    keys, and every task packs its own longest first, ties by ``order``. Ids are unique,
    with gaps between tasks. A length that is null, under 1 or over ``capacity`` is an
    error. The rows are read twice, so store them first if they are costly. Columns
    called like the added ones are replaced; no rows give none.
    """
    pieces = pieces.drop("sequence_id", "offset")
    wrong = F.col("length").isNull() | ~F.col("length").between(1, capacity)
    total, bad = pieces.agg(F.sum("length"), F.count_if(wrong)).first()
    if bad:
        raise ValueError(f"{bad} pieces have no length from 1 to {capacity}")
    tasks = max(1, -(-(total or 0) // (capacity * task_sequences)))
    fields = [StructField(n, LongType(), False) for n in ("sequence_id", "offset")]
    schema = StructType(pieces.schema.fields + fields)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            new = [pa.array([p[i] for p in placed], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    dealt = pieces.repartition(tasks)
    return dealt.sortWithinPartitions(F.desc("length"), *order).mapInArrow(fill, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    columns: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Documents tokenised, cut and packed; one row per piece.

    Null texts count as empty, so every row gives at least its end id; repeated rows are
    packed each. Pieces are written to the shared folder between the two passes.
    """
    pieces = tokenised_pieces(
        docs,
        tokenizer_path,
        ranks_path=ranks_path,
        pattern=pattern,
        capacity=capacity,
        keep_ids=keep_ids,
        columns=columns,
    )
    return pack(stored(pieces, "pieces"), capacity=capacity, order=("piece",))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed pieces' ids joined in order, at most ``capacity``."""
    items = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    joined = F.array_join(F.transform(items, lambda x: x.hex), "")
    return packed.groupBy("sequence_id").agg(F.unhex(joined).cast(BinaryType()).alias("ids"))
