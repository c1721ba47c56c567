"""Operator 9, approximate nearest neighbours: a small-world graph per shard, results merged."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import prepare_workers, stored
from tidemark.llm.small_world import LINKS, SEARCH_WIDTH, Frame, Graph, Points, build

#: Vectors of one shard, and bytes of them at most.
SHARD_ROWS, SHARD_BYTES = 8192, 8 << 20
#: Bytes of query vectors that every task gets at a time.
QUERY_BYTES = 8 << 20
BLOCK = 256
#: Powers of two that the vectors of one graph span at most.
SPAN = 16
#: A query that many times farther off than a graph is wide is compared with all its vectors.
FAR, WHOLE_CELLS = 1e5, 1 << 22
INDEX = (
    "shard int, dim int, ids binary, ends binary, vectors binary,"
    " layers array<struct<size:int,links:binary>>"
)
HITS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of rows whose vectors are neither null, zero nor unsound."""
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"))
    unsound = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~unsound
    return rows.filter(sound & F.exists("embedding", lambda x: x != 0))


def equal_groups(vectors: DataFrame, k: int) -> DataFrame:
    """``ids, embedding``: every vector once, with the smallest ids that have it.

    There are the ``k + 1`` smallest ids in order, each as often as it repeats but ``k`` times
    at most: more can't be among ``k`` hits, one of the ids being the query's own. The limit
    applies before rows are dealt out, so a vector that most rows share is no hot key.
    """
    counted = usable(vectors).groupBy("embedding", "vec_id").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = counted.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k + 1)
    copies = F.least("copies", F.lit(k)).cast("int").alias("copies")
    ids = F.sort_array(F.collect_list(F.struct("vec_id", copies)))
    repeated = F.flatten(F.transform(ids, lambda x: F.array_repeat(x.vec_id, x.copies)))
    return ranked.groupBy("embedding").agg(repeated.alias("ids")).select("ids", "embedding")


def build_index(groups: DataFrame) -> DataFrame:
    """One row per shard and dimension: ids, vectors, and the graph as flat neighbour arrays.

    ``groups`` are ``ids, embedding``; ``ends`` tells where each one's ids end. Rows are dealt
    out evenly, so no key can be hot. The index is stored.
    """
    count, dim = groups.agg(F.count("*"), F.max(F.size("embedding"))).first()
    size = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * (dim or 1))))
    shards = max(1, -(-count // size))

    schema = StructType.fromDDL(INDEX)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = defaultdict(list)
        for batch in batches:
            for ids, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = v.values.to_numpy(zero_copy_only=False)
                by_dim[len(vector)].append((ids, vector))
        made = []
        for dim, members in _alike(by_dim):
            values = np.array([m[1] for m in members], np.float64)
            # Levels are drawn from the place in the shard, so a repeated task draws the same.
            draws = np.random.Generator(np.random.PCG64(dim)).random(len(values))
            levels = np.floor(-np.log(1 - draws) / np.log(LINKS)).astype(int)
            order = np.argsort(-levels, kind="stable")
            graph = build(Frame(values[order]).place(values[order]), levels[order])
            layers = [
                {"size": len(nodes), "links": links.astype("<i4").tobytes()}
                for nodes, links in graph.layers
            ]
            own = [members[k][0] for k in order]
            ids, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
            parts = [x.tobytes() for x in (ids.astype(np.int64), ends, values[order])]
            made.append((dim, *parts, layers))
        shard = TaskContext.get().partitionId()
        columns = [[shard] * len(made), *map(list, zip(*made, strict=True))] if made else [[]] * 6
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    prepare_workers(groups.sparkSession)
    return stored(groups.repartition(shards).mapInArrow(index, schema), "index")


def _alike(by_dim: dict[int, list]) -> Iterator[tuple[int, list]]:
    """Members of one dimension and of like size, so that one frame fits them all.

    What usually lies in one shard is of one size. Where it isn't there are some more graphs.
    """
    for dim, members in sorted(by_dim.items()):
        _, powers = np.frexp([np.abs(v).max() for _, v in members])
        order = np.argsort(powers, kind="stable")
        start = 0
        for k in range(1, len(order) + 1):
            if k == len(order) or powers[order[k]] - powers[order[start]] > SPAN:
                yield dim, [members[i] for i in sorted(order[start:k])]
                start = k


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis, also where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        gaps = a - b
        squares = np.einsum("...d,...d->...", gaps, gaps)
        lost = ~((squares > 1e-280) & (squares < 1e300))
        if lost.any():
            own = gaps[lost]
            _, power = np.frexp(np.abs(own).max(axis=-1))
            own = np.ldexp(own, -power[:, None])
            squares[lost] = np.einsum("...d,...d->...", own, own)
            lengths = np.sqrt(squares)
            lengths[lost] = np.ldexp(lengths[lost], power)
            return lengths
        return np.sqrt(squares)


class _Shard:
    def __init__(self, dim: int, ids: bytes, ends: bytes, vectors: bytes, layers: list[dict]):
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.starts = np.r_[0, self.ends[:-1]]
        #: Whether all ids of a vector are the same one.
        self.sole = self.ids[self.starts] == self.ids[self.ends - 1]
        self.values = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.frame = Frame(self.values)
        self.points = Points(self.frame.place(self.values))
        flat = [np.frombuffer(x["links"], "<i4").reshape(x["size"], -1) for x in layers]
        self.graph = Graph([(np.arange(len(links)), links.astype(np.int64)) for links in flat])

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, width: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and exact distances of up to ``k`` near rows of each query.

        Queries far off, for which the graph's vectors look alike, and those that the graph
        gives too few vectors are compared with all of them.
        """
        count = len(self.ends)
        whole = np.full(len(queries), count <= width)
        parts = []
        if count > width:
            placed = self.frame.place(queries)
            whole = ~(np.abs(placed).max(axis=1) < FAR)
            near = np.flatnonzero(~whole)
            if near.size:
                found = self.graph.search(self.points, placed[near].astype(np.float32), width)
                few = (found >= 0).sum(axis=1) < min(k + 1, count)
                whole[near[few]] = True
                parts.append(self._nearest(query_ids[near[~few]], queries[near[~few]], found[~few], k))
        rest = np.flatnonzero(whole)
        step = max(1, WHOLE_CELLS // max(1, self.values.size))
        for low in range(0, len(rest), step):
            some = rest[low : low + step]
            found = np.broadcast_to(np.arange(count), (len(some), count))
            parts.append(self._nearest(query_ids[some], queries[some], found, k))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _nearest(
        self, query_ids: np.ndarray, queries: np.ndarray, found: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the vectors ``found`` for each query (-1: none), the rows of the ``k`` nearest."""
        gaps = distances(self.values[found], queries[:, None, :])
        first = self.ids[self.starts[found]]
        own = (found < 0) | self.sole[found] & (first == query_ids[:, None])
        gaps = np.where(own, np.inf, gaps)
        # Each of the k nearest vectors, and of those that tie with them, has a row at least.
        last = min(k, gaps.shape[1]) - 1
        taken = ~own & (gaps <= np.partition(gaps, last, axis=1)[:, last : last + 1])
        who, _ = np.nonzero(taken)
        spot, gap = found[taken], gaps[taken]
        counts = self.ends[spot] - self.starts[spot]
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = self.ids[np.repeat(self.starts[spot], counts) + nth]
        who, gap = np.repeat(who, counts), np.repeat(gap, counts)
        other = ids != query_ids[who]
        who, ids, gap = who[other], ids[other], gap[other]
        order = np.lexsort((ids, gap, who))
        who, ids, gap = who[order], ids[order], gap[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        return query_ids[who[rank < k]], ids[rank < k], gap[rank < k]


def _hits(index: DataFrame, queries: list, k: int, width: int) -> DataFrame:
    by_dim: dict[int, list] = defaultdict(list)
    for query in queries:
        by_dim[len(query.embedding)].append(query)
    packed = {
        dim: (np.array([q.vec_id for q in own]), np.array([q.embedding for q in own]))
        for dim, own in by_dim.items()
    }
    shared = index.sparkSession.sparkContext.broadcast(packed)
    schema = StructType.fromDDL(HITS)
    names = schema.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, dim, *parts = (c[row].as_py() for c in batch.columns)
                if dim not in shared.value:
                    continue
                shard, (ids, values) = _Shard(dim, *parts), shared.value[dim]
                for low in range(0, len(ids), BLOCK):
                    some = slice(low, low + BLOCK)
                    found = shard.search(ids[some], values[some], k, width)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=names)

    return index.mapInArrow(search, schema)


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, width: int = SEARCH_WIDTH
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found of each query.

    Both tables have ``vec_id, embedding``. Nearness is Euclidean distance in double
    precision on the given vectors, of any finite size: graphs are searched after a shift and
    a scaling of their own, and vectors of very different size are in different graphs. Ties go to the smaller vec_id, and a query's own id is no
    candidate. Every shard's graph is searched with a beam of ``width``; shards no larger
    than that are compared whole, so few vectors give all candidates. Rows with a null id or
    a vector that is null, empty, zero or has null or non-finite components take no part;
    vectors of another dimension are no candidates. Equal vectors are searched as one and are
    candidates each, so that any number of copies ties by vec_id; an id that is queried repeatedly is searched once, by its smallest vector.

    Queries reach the tasks in blocks of at most about ``QUERY_BYTES``, one after another.
    """
    index = build_index(stored(equal_groups(vectors, k), "groups"))
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(asked, "queries")
    size = asked.agg(F.sum(8 * F.size("embedding"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    hits = None
    for block in range(blocks):
        chosen = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        found = stored(_hits(index, chosen, k, width), "hits")
        hits = found if hits is None else hits.union(found)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
