"""Operator 7, near-duplicates by an inverted join on the coordinates of MinHash signatures.

Documents with the same set of shingles form a class first, so copies count once. A
class is posted under coordinate-value pairs of its signature. Two classes that agree in
at least ``least`` of ``coordinates`` share a pair among the first ``coordinates - least
+ 1`` in any common order; with frequent pairs last in that order, the long posting lists
are skipped unless all of a signature is frequent.

Lists aren't expanded into pairs. First every member is compared with its list's smallest
class. What may be left are links between members of one list that are in different parts
then. Lists of up to ``SHORT_LIST`` members give those few pairs; longer ones are cut into
blocks of bounded size, parts kept together, and pairs of blocks that hold more than one
part are compared as matrices: by signatures to tell which members have candidates at all,
then those with the full sets at hand. They give links only, and of those only what joins
parts that were apart, so neither a large group of variants nor one just under the
threshold makes more pairs than it has members. Candidates must agree in ``least``
coordinates and in a second, finer sketch, and the full sets confirm every link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import arrow_map, other_columns_aside, prepare_workers, stored
from tidemark.llm.components import connected_components

#: Bytes: A-Z to a-z, all others as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: At most so many coordinate-value pairs count as frequent, whatever the number of documents.
FREQUENT_PAIRS = 1_000_000
#: A value is frequent that comes so often among one in so many classes.
LEAST_FREQUENT, COUNTED_SHARE = 2, 16
#: Members of a list that are compared by a join, of a block of longer lists, and rows of a task's share.
SHORT_LIST, BLOCK, SHARE = 32, 2048, 16_384
#: Shingles of a block's sets and of a task's share, 8 bytes each; a larger set is alone.
BLOCK_SHINGLES, SHARE_SHINGLES = 1_000_000, 2_000_000
#: Bins of the finer sketch, a byte each.
BINS = 256
#: Standard deviations that estimates may lie under what is asked for.
DEVIATIONS = 6.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words, linked from ``percent`` similarity on.

    Of ``coordinates`` equal ones, ``least`` make a candidate: 4.7 standard deviations
    under what is expected at 80 percent, where fewer agree with a chance of 4.2 in a million.
    """

    words: int = 5
    percent: int = 80
    coordinates: int = 64
    least: int = 36

    @property
    def multipliers(self) -> np.ndarray:
        draws = np.random.Generator(np.random.PCG64(20_240_607))
        return draws.integers(0, 2**63, self.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of a shorter text, of all its words."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([digest(b" ".join(words), seed=len(words))], np.uint64)
    single = np.array([digest(w) for w in words], np.uint64)
    count = len(words) - size + 1
    mixed = np.zeros(count, np.uint64)
    for k in range(size):
        mixed = (mixed ^ single[k : k + count]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """32 mixed bits of the smallest value of every coordinate's hash function."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max)
    for low in range(0, len(hashes), 2048):
        block = hashes[low : low + 2048]
        np.minimum(least, (multipliers[:, None] * block).min(axis=1), out=least)
    return ((least * _MIX) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fine_sketch(hashes: np.ndarray) -> bytes:
    """A byte of the smallest hash of each bin of hashes, 0 for an empty bin."""
    bins, first = np.unique((hashes >> np.uint64(56)).astype(np.intp), return_index=True)
    sketch = np.zeros(BINS, np.uint8)
    sketch[bins] = (hashes[first] >> np.uint64(24)) % np.uint64(255) + np.uint64(1)
    return sketch.tobytes()


def fine_enough(
    a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int
) -> np.ndarray:
    """Whether sketches, a row each, agree as similar sets would but for a rare chance.

    The filled bins are a sample of the union without replacement, so the fewer shingles
    there are for each bin, the surer the estimate.
    """
    both = ((a == b) & (a > 0)).sum(axis=1)
    filled = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    share = percent / 100
    union = (sizes_a + sizes_b) / (1 + share)
    left_out = np.maximum(1 - filled / np.maximum(union, 1), 0.1)
    deviation = np.sqrt(share * (1 - share) / filled * left_out)
    return both / filled >= share - DEVIATIONS * deviation


def _set_digest(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, signature`` of every row; nulls without shingles."""
    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    added = "n_shingles long, digest binary, signature array<int>, sketch binary"
    schema = StructType([*given.schema.fields[:2], *StructType.fromDDL(added).fields])

    def sign(batch: pa.RecordBatch) -> dict[str, list]:
        multipliers = settings.multipliers
        rows: dict[str, list] = {n: [] for n in schema.names}
        for text in batch.column(2):
            hashes = shingle_hashes(words_of(text.as_py() or ""), settings.words)
            rows["n_shingles"].append(len(hashes))
            rows["digest"].append(_set_digest(hashes) if len(hashes) else None)
            values = signature(hashes, multipliers) if len(hashes) else None
            rows["signature"].append(values)
            rows["sketch"].append(fine_sketch(hashes) if len(hashes) else None)
        return rows | {"doc_id": batch.column(0), "text_hash": batch.column(1)}

    return arrow_map(given, sign, schema)


def _postings(classes: DataFrame, settings: Settings) -> DataFrame:
    """``digest, n, posted, tokens``: the first coordinate-value pairs of every class, stored.

    Rare ones come first. How often values occur is counted over a share of the classes, told
    by a hash: any order that all classes have in common gives the same links, so the share
    decides how long lists are and nothing else. ``posted`` has a bit for each coordinate posted.
    """
    # A value of one coordinate is another token than the same value of another one.
    share = F.pmod(F.xxhash64("digest"), F.lit(COUNTED_SHARE)) == 0
    tokens = classes.filter(share).select(F.posexplode("signature").alias("at", "value"))
    low = F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    tokens = tokens.select(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(low).alias("token"))
    total = classes.count() * settings.coordinates // COUNTED_SHARE
    floor = max(LEAST_FREQUENT, total // FREQUENT_PAIRS)
    frequent = tokens.groupBy("token").count().filter(F.col("count") >= floor).toArrow()
    known, often = (frequent.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(known)
    known, often = known[order], often[order]
    shared = classes.sparkSession.sparkContext.broadcast((known, often))
    schema = StructType.fromDDL("digest binary, n long, posted long, tokens array<long>")
    prefix = settings.coordinates - settings.least + 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            values = _matrix(batch.column(2), settings.coordinates, np.uint32).astype(np.int64)
            values |= np.arange(settings.coordinates) << 32
            counts = np.zeros(values.shape, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                counts = np.where(known[at] == values, often[at], 0)
            order = np.lexsort((values, counts), axis=1)[:, :prefix]
            chosen = np.take_along_axis(values, order, 1)
            posted = np.bitwise_or.reduce(np.uint64(1) << order.astype(np.uint64), axis=1).view(np.int64)
            offsets = np.arange(0, chosen.size + 1, prefix, dtype=np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(chosen.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(posted), lists], names=schema.names
            )

    prepare_workers(classes.sparkSession)
    return stored(classes.select("digest", "n", "signature").mapInArrow(first, schema), "postings")


#: A table of at most so many short rows may be broadcast; larger ones are joined by shuffles.
SMALL_ROWS = 200_000


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _traits(classes: DataFrame) -> DataFrame:
    """``digest, signature, sketch, n``, the signature by a byte of each coordinate.

    One in 256 unequal values agrees by chance.
    """
    low = F.transform("signature", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("byte"))
    return classes.select("digest", low.alias("signature"), "sketch", "n")


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Equally long lists or byte strings as the rows of a matrix."""
    if pa.types.is_list(column.type):
        values = column.flatten().to_numpy(zero_copy_only=False)
        same = values.dtype.itemsize == np.dtype(kind).itemsize
        return (values.view(kind) if same else values.astype(kind)).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class _Sets:
    """Signatures and full sets of classes, for confirming links."""

    def __init__(self, docs: DataFrame, classes: DataFrame, settings: Settings):
        self.docs, self.classes, self.settings = docs, classes, settings

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose signatures and sketches agree often enough."""
        settings = self.settings
        ends = _traits(self.classes)
        for name in "ab":
            traits = ("signature", "sketch", "n")
            renamed = {"digest": name} | {x: f"_{x}_{name}" for x in traits}
            pairs = pairs.join(ends.withColumnsRenamed(renamed), name)
        schema = StructType.fromDDL("a binary, b binary")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                left, right = (_matrix(batch.column(k), settings.coordinates, np.int8) for k in (2, 4))
                fine = [_matrix(batch.column(k), BINS, np.uint8) for k in (3, 5)]
                keep = (left == right).sum(axis=1) >= settings.least
                sizes = (batch.column(k).to_numpy() for k in (6, 7))
                keep &= fine_enough(*fine, *sizes, settings.percent)
                yield batch.select([0, 1]).filter(pa.array(keep))

        prepare_workers(pairs.sparkSession)
        columns = ["a", "b", *(f"_{x}_{y}" for y in "ab" for x in ("signature", "sketch")), "_n_a", "_n_b"]
        return pairs.select(*columns).mapInArrow(near, schema)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are similar enough on their full sets."""
        percent = self.settings.percent
        pairs = stored(pairs.select("a", "b"), "candidates")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        sets = stored(self.of(needed), "sets")
        left = sets.withColumnsRenamed({"digest": "a", "hashes": "_left"})
        right = sets.withColumnsRenamed({"digest": "b", "hashes": "_right"})
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("_left", "_right"))
        counted = both.select(
            "a", "b", common.alias("common"), (F.size("_left") + F.size("_right")).alias("sizes")
        )
        union = F.col("sizes") - F.col("common")
        similar = counted.filter(100 * F.col("common").cast("long") >= percent * union.cast("long"))
        return similar.select("a", "b")

    def of(self, needed: DataFrame) -> DataFrame:
        """``digest, hashes`` of the classes ``needed``, made anew from one document's text each."""
        wanted = self.classes.join(needed, "digest").select(
            F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")
        )
        wanted = _broadcast_if_small(stored(wanted, "wanted"))
        texts = self.docs.select("doc_id", "text")
        chosen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "_digest")
        schema = StructType.fromDDL("digest binary, hashes array<long>")
        words = self.settings.words

        def build(batch: pa.RecordBatch) -> dict[str, list]:
            rows: dict[str, list] = {"digest": [], "hashes": []}
            texts, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text, digest in zip(texts, digests, strict=True):
                hashes = shingle_hashes(words_of(text or ""), words)
                # Other texts may have the same id.
                if len(hashes) and _set_digest(hashes) == digest:
                    rows["digest"].append(digest)
                    rows["hashes"].append(hashes.view(np.int64))
            return rows

        return arrow_map(chosen, build, schema).dropDuplicates(["digest"])


def _links(docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """``a, b``: links that connect all classes that similar pairs connect."""
    if settings.coordinates > 64:
        raise ValueError("at most 64 coordinates have a bit each")
    sets = _Sets(docs, classes, settings)
    postings = _postings(classes, settings)
    lists = postings.select("digest", "n", F.explode("tokens").alias("token"))
    heads = lists.groupBy("token").agg(
        F.min(F.struct("digest", "n")).alias("head"),
        F.count("*").alias("members"),
        F.sum("n").alias("weight"),
    )
    lists = stored(lists.join(heads.filter("members > 1"), "token"), "lists")
    alike = _sizes_allow(F.col("n"), F.col("head.n"), settings.percent)
    stars = (
        lists.filter((F.col("digest") != F.col("head.digest")) & alike)
        .select(F.col("head.digest").alias("a"), F.col("digest").alias("b"))
        .distinct()
    )
    near = stored(sets.confirmed(sets.candidates(stars)), "links")
    # Lists of two were compared in full.
    longer = stored(_mixed(lists.filter("members > 2"), near), "open")
    short = _short_lists(longer.filter(F.col("members") <= SHORT_LIST), settings)
    short = sets.confirmed(sets.candidates(short.join(near, ["a", "b"], "left_anti")))
    long = _long_lists(longer.filter(F.col("members") > SHORT_LIST), sets, postings, settings)
    return near.union(short).union(long)


def _mixed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``token, members, weight, digest, n, part`` of the lists whose members are in several parts.

    A list inside one part has nothing left to find.
    """
    parts = connected_components(links).withColumnsRenamed({"node": "digest", "component": "part"})
    rows = lists.select("token", "members", "weight", "digest", "n").join(parts, "digest", "left")
    rows = stored(rows.withColumn("part", F.coalesce("part", "digest")), "open")
    ends = rows.groupBy("token").agg(F.min("part").alias("_low"), F.max("part").alias("_high"))
    return rows.join(ends.filter("_low <> _high").select("token"), "token")


def _short_lists(lists: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of a list's members in different parts; some ten for each member at most."""
    left = lists.select("token", F.col("digest").alias("a"), F.col("n").alias("_n"), F.col("part").alias("_part"))
    right = lists.select("token", F.col("digest").alias("b"), "n", "part")
    pairs = left.join(right, "token").filter("a < b AND part <> _part")
    return pairs.filter(_sizes_allow(F.col("n"), F.col("_n"), settings.percent)).select("a", "b").distinct()


def _blocks(count: Column, weight: Column) -> Column:
    """How many blocks so many members with so many shingles make."""
    return F.ceil(F.greatest(count / BLOCK, weight / BLOCK_SHINGLES)).cast("int")


def _long_lists(lists: DataFrame, sets: _Sets, postings: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that join what a list's members in different parts join, found block by block.

    A pair that shares several lists is looked at in the first one alone. Every block gives at
    most one link fewer than it has parts.

    A block holds some ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles; a part that has more
    has blocks of its own, and two blocks of the same single part aren't compared. Tasks get
    shares of some ``SHARE`` rows and ``SHARE_SHINGLES`` shingles.
    """
    rows = stored(lists, "long")
    parts = rows.groupBy("token", "part").agg(F.count("*").alias("_count"), F.sum("n").alias("_weight"))
    spread = _blocks(F.col("_count"), F.col("_weight"))
    own = F.pmod(F.xxhash64("digest"), spread)
    among = F.pmod(F.xxhash64("part"), _blocks(F.col("members"), F.col("weight")))
    alone = F.xxhash64(F.lit("part"), "part", own)
    rows = rows.join(parts, ["token", "part"]).withColumn(
        "block", F.when(spread > 1, alone).otherwise(F.xxhash64(F.lit("all"), among))
    )
    rows = stored(rows.select("token", "block", "digest", "n", "part"), "blocks")
    blocks = rows.groupBy("token", "block").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    other = blocks.withColumnsRenamed({"block": "other", "low": "_low", "high": "_high"})
    one_part = (F.col("low") == F.col("high")) & (F.col("_low") == F.col("_high")) & (F.col("low") == F.col("_low"))
    meetings = blocks.join(other, "token").filter((F.col("block") <= F.col("other")) & ~one_part)
    meetings = meetings.select("token", "block", "other", F.xxhash64("token", "block", "other").alias("meeting"))
    sides = meetings.select("token", "block", "meeting", F.lit(True).alias("first"))
    second = meetings.select("token", F.col("other").alias("block"), "meeting", F.lit(False).alias("first"))
    placed = rows.join(sides.union(second.join(sides, ["token", "block", "meeting"], "left_anti")), ["token", "block"])
    placed = stored(placed.drop("block"), "meetings")
    posted = postings.select("digest", "posted")
    traits = sets.classes.select("digest", "signature", "sketch").join(posted, "digest")

    def screen(rows: pa.Table) -> pa.Table:
        active = np.zeros(rows.num_rows, bool)
        for a, others in _agreeing(rows, settings):
            active[a] = active[others] = True
        return rows.select(MEMBER).filter(pa.array(active))

    screened = _by_meeting(placed.join(traits, "digest"), placed, screen, placed.select(*MEMBER).schema)
    active = stored(screened, "active")
    needed = active.select("digest").distinct()
    # Joined as they are dealt, so the sets are shuffled once to their class and once to a meeting.
    full = sets.of(needed).join(traits.drop("sketch"), "digest")

    def link(rows: pa.Table) -> pa.Table:
        found = _meet(rows, settings)
        return pa.Table.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    linked = _by_meeting(active.join(full, "digest"), active, link, StructType.fromDDL("a binary, b binary"))
    return stored(linked.distinct(), "links")


#: What is known of a member of a meeting.
MEMBER = ["meeting", "token", "first", "digest", "n", "part"]


def _by_meeting(
    rows: DataFrame, members: DataFrame, work: Callable[[pa.Table], pa.Table], schema: StructType
) -> DataFrame:
    """What ``work`` makes of every meeting's rows; ``members`` tells how many shares that takes."""
    held = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shares = max(1, held[0] // SHARE, held[1] // SHARE_SHINGLES)

    def run(share_rows: pa.Table) -> pa.Table:
        order = share_rows.drop_columns("share").sort_by("meeting")
        edges = np.flatnonzero(np.diff(order.column("meeting").to_numpy())) + 1
        met = zip([0, *edges], [*edges, order.num_rows], strict=True)
        return pa.concat_tables([work(order.slice(low, high - low)) for low, high in met])

    prepare_workers(rows.sparkSession)
    shared = rows.withColumn("share", F.pmod(F.xxhash64("meeting"), F.lit(shares))).groupBy("share")
    return shared.applyInArrow(run, schema)


def _agreeing(rows: pa.Table, settings: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """A row and its candidates, likeliest first, in one block or between two.

    A candidate is in another part, and this list is the first that the two share.
    """
    rows = rows.combine_chunks()
    sizes = rows.column("n").to_numpy()
    _, part = np.unique(np.array(rows.column("part").to_pylist(), object), return_inverse=True)
    sketches = None
    if "sketch" in rows.column_names:
        sketches = _matrix(rows.column("sketch").chunk(0), BINS, np.uint8)
    signatures = _matrix(rows.column("signature").chunk(0), settings.coordinates, np.int32)
    posted = rows.column("posted").to_numpy().view(np.uint64)
    bits = np.uint64(1) << np.arange(settings.coordinates, dtype=np.uint64)
    coordinate = rows.column("token")[0].as_py() >> 32
    first = rows.column("first").to_numpy()
    left = np.flatnonzero(first)
    right = left if first.all() else np.flatnonzero(~first)
    for low in range(0, len(left), 256):
        some = left[low : low + 256]
        agree = np.zeros((len(some), len(right)), np.int16)
        for k in range(settings.coordinates):
            agree += signatures[some, k][:, None] == signatures[right, k][None, :]
        small, large = sizes[some][:, None], sizes[right][None, :]
        fits = (100 * small >= settings.percent * large) & (100 * large >= settings.percent * small)
        fits &= (part[some][:, None] != part[right][None, :]) & (agree >= settings.least)
        if right is left:
            fits &= some[:, None] < right[None, :]
        for i in np.flatnonzero(fits.any(axis=1)):
            a, near = some[i], np.flatnonzero(fits[i])
            b = right[near[np.argsort(-agree[i, near], kind="stable")]]
            shared = (signatures[a] == signatures[b]) & ((posted[a] & posted[b])[:, None] & bits > 0)
            b = b[shared.argmax(axis=1) == coordinate]
            if sketches is not None and len(b):
                b = b[fine_enough(sketches[[a]], sketches[b], sizes[a], sizes[b], settings.percent)]
            if len(b):
                yield a, b


def _meet(rows: pa.Table, settings: Settings) -> list[tuple[bytes, bytes]]:
    """Links among the members of one block, or between those of two, that join their parts."""
    rows = rows.combine_chunks()
    digests, sizes = rows.column("digest").to_pylist(), rows.column("n").to_numpy()
    _, part = np.unique(np.array(rows.column("part").to_pylist(), object), return_inverse=True)
    hashes = rows.column("hashes").chunk(0).flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(sizes)
    of = [hashes[end - size : end] for end, size in zip(ends, sizes, strict=True)]
    joined = _Joined(int(part.max()) + 1)
    found: list[tuple[int, int]] = []
    for a, others in _agreeing(rows, settings):
        for at in range(0, len(others), 128):
            b = others[at : at + 128]
            b = b[[joined.apart(part[a], part[x]) for x in b]]
            if len(b):
                similar = b[_similar(of[a], [of[x] for x in b], settings.percent)]
                found += [(a, x) for x in similar if joined.join(part[a], part[x])]
    return [tuple(sorted((digests[x], digests[y]))) for x, y in found]


def _similar(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets, sorted and none of them empty, are similar enough to this one."""
    sizes = np.array([len(x) for x in others])
    together = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, together), len(own) - 1)
    common = np.add.reduceat((own[at] == together).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(own) + sizes - common)


class _Joined:
    """Which of a block's parts its links have joined so far."""

    def __init__(self, count: int):
        self.up = list(range(count))

    def _end(self, node: int) -> int:
        while self.up[node] != node:
            self.up[node] = self.up[self.up[node]]
            node = self.up[node]
        return node

    def apart(self, a: int, b: int) -> bool:
        return self._end(a) != self._end(b)

    def join(self, a: int, b: int) -> bool:
        """Whether this joins two that were apart."""
        a, b = self._end(a), self._end(b)
        self.up[b] = a
        return a != b


def _judged(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, n_shingles, digest, text_hash, component`` of every row.

    ``component`` is the digest that names the row's component, null without shingles.
    """
    rows = stored(_signed(docs, settings), "signed")
    named = rows.filter("digest IS NOT NULL").groupBy("digest")
    first = [F.first(c).alias(n) for c, n in (("n_shingles", "n"), *((x, x) for x in ("signature", "sketch")))]
    classes = stored(named.agg(F.min("doc_id").alias("doc_id"), *first), "classes")
    parts = connected_components(_links(docs, classes, settings))
    moved = parts.filter("node <> component").withColumnRenamed("node", "digest")
    return (
        rows.drop("signature", "sketch")
        .join(moved, "digest", "left")
        .withColumn("component", F.coalesce("component", "digest"))
    )


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Words are what white space (ASCII) divides after A-Z are lower-cased; a set holds the
    distinct shingles, for fewer words the whole sequence. Rows are linked where common
    shingles are at least ``percent`` of all; ``component_id`` is the smallest doc_id that
    links reach, and ``kept`` says that it is the row's own. Rows without words, null texts
    among them, have an empty set and are their own component. Equal sets are one class,
    so repeated rows share a component, and are both kept if they share the smallest id. A
    null doc_id counts as larger than all others; other columns are ignored.

    No step collects documents, links or components, and none makes all pairs of a list.
    """
    rows = _judged(docs, settings)
    named = rows.filter("component IS NOT NULL").groupBy("component")
    smallest = named.agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(smallest, "component", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    result = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@other_columns_aside("doc_id", "text")
def without_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` less all but one of each component, with all their columns.

    Of a component the row with the smallest doc_id stays, null last, of several such rows
    one of the text with the smallest hash. Rows without words all stay.
    """
    judged = _judged(docs, settings).filter("component IS NOT NULL")
    texts = stored(
        judged.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows")), "texts"
    )
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = texts.groupBy("component").agg(F.min(rank).alias("_first"))
    placed = texts.join(first, "component").withColumn("stays", rank == F.col("_first"))
    # Only texts that go, or that stay but are repeated, need a second look.
    decided = placed.filter("NOT stays OR rows > 1").select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "stays"
    )
    decided = _broadcast_if_small(stored(decided, "decided"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    untouched = docs.join(decided, same, "left_anti")
    repeated = docs.join(decided.filter("stays"), same).select(*docs.columns, "_hash")
    return untouched.union(repeated.dropDuplicates(["doc_id", "_hash"]).drop("_hash"))
