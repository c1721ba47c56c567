"""Operator 3, HTML extraction by differencing a page with the page of the nearest URL.

Elements that can't be part of an article go first. Every page is then aligned, line by line,
with the page of the nearest URL path on the same host, and the lines of the longest common
subsequence are deleted as boilerplate, except those that the page marks as its article:
copies and licence lines are part of articles.

A page that is much the same as a whole tells nothing about what is boilerplate. Equal pages
of a host count once, and of near copies none is compared with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import arrow_map, other_columns_aside, prepare_workers, stored
from tidemark.llm.page_blocks import blocks_of, common
from tidemark.llm.url_filter import url_host, url_path

PARSED = "_text string, _lines array<string>, _keys binary, _list binary"
#: Bytes of a line's key: 16 of its digest, 4 of its length, and whether an article holds it.
KEY = 21
#: Pages of one host with so much in common, by length of all their lines, are near copies.
COPY_PERCENT = 80
#: Near copies that wait in a task for the next page; more are left to joins.
WAITING = 4096
#: Pages on either side in the first join, and how many times more in each one after it.
REACH, GROWTH = 1, 8


def _keys(lines: list[str], marked: list[bool]) -> bytes:
    import xxhash

    parts = []
    for line, own in zip(lines, marked, strict=True):
        parts += [xxhash.xxh3_128_digest(line), len(line).to_bytes(4, "little"), bytes([own])]
    return b"".join(parts)


class Page:
    """Keys of a page's lines, in order."""

    def __init__(self, keys: bytes, path: str):
        rows = [keys[k : k + KEY] for k in range(0, len(keys), KEY)]
        self.keys, self.path = keys, path
        self.lines = [r[:16] for r in rows]
        self.marked = [bool(r[20]) for r in rows]
        self.sizes = {r[:16]: int.from_bytes(r[16:20], "little") for r in rows}

    def copies(self, other: Page) -> bool:
        """Whether the two are near copies of each other."""
        both = sum(n for line, n in self.sizes.items() if line in other.sizes)
        union = sum(self.sizes.values()) + sum(other.sizes.values()) - both
        return 100 * both >= COPY_PERCENT * union


def deleted(
    page: Page, before: list[Page], after: list[Page], ends: tuple[bool, bool]
) -> tuple[list[int], int] | None:
    """Places of the lines that go, and how many shared lines the page's article keeps.

    ``before`` and ``after`` hold the host's other pages, nearest first; ``ends`` tells whether
    those are all on that side. The page whose path begins most alike counts that is no near
    copy and leaves something; without one all lines stay. None: pages further on may count.
    """
    sides = (before, after)
    near = sorted(
        (-_alike(page.path, other.path), k, side)
        for side, others in enumerate(sides)
        for k, other in enumerate(others)
    )
    # Beyond what is known no page is more alike than the last one that is.
    limits = [
        None if end else _alike(page.path, others[-1].path) if others else len(page.path)
        for others, end in zip(sides, ends, strict=True)
    ]
    for alike, k, side in near:
        limit = limits[1 - side]
        if limit is not None and limit > -alike:
            return None
        other = sides[side][k]
        if page.copies(other):
            continue
        shared = common(page.lines, other.lines)
        gone = sorted(x for x in shared if not page.marked[x])
        if len(gone) < len(page.lines):
            return gone, len(shared) - len(gone)
    return ([], 0) if all(ends) else None


def _parsed(pages: DataFrame) -> DataFrame:
    """``pages`` without html, plus the keys of all lines and ``_text`` or ``_lines``.

    ``_text`` is for pages whose lines are all an article's.
    """
    columns = [c for c in pages.columns if c != "html"]
    given = pages.select(*columns, F.coalesce("html", F.lit("")).alias("_html"))
    schema = StructType(given.schema.fields[:-1] + StructType.fromDDL(PARSED).fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for page in batch.column(batch.num_columns - 1):
                blocks = blocks_of(page.as_py())
                fixed = all(blocks.marked)
                keys = _keys(blocks.lines, blocks.marked)
                text, lines = (" ".join(blocks.lines), None) if fixed else (None, blocks.lines)
                rows.append((text, lines, keys, xxhash.xxh3_128_digest(keys)))
            kinds = (pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary())
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    prepare_workers(pages.sparkSession)
    return given.mapInArrow(parse, schema)


def _in_url_order(lists: DataFrame) -> DataFrame:
    """``lists`` in runs of near copies, and what a page's own task can tell of ``_gone``.

    Sorted by ranges, so a host that holds most pages is spread over tasks. A run begins where
    a page is no near copy of the run's first one; ``_place`` numbers the runs over all tasks.
    """
    order = ["_host", "_path", "_list"]
    rows = lists.select(*order, "_keys")
    added = "_task int, _run long, _nth long, _gone array<int>, _held int"
    schema = StructType(rows.schema.fields + StructType.fromDDL(added).fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, task = to_arrow_schema(schema), TaskContext.get().partitionId()
        done: list[tuple] = []
        waiting: list[tuple[tuple, Page]] = []
        run, host, first, last, begun, before = -1, None, None, None, False, None

        def settle(after: list[Page], ended: bool) -> None:
            for row, page in waiting:
                ends = (begun and not before, ended)
                found = deleted(page, [before] if before else [], after, ends)
                done.append((*row, *(found or (None, None))))
            waiting.clear()

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array([r[k] for r in done], f.type) for k, f in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=kinds)

        nth = 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(values[3], values[1])
                if run < 0 or values[0] != host:
                    settle([], True)
                    # Pages of a task's first host may have others in the task before.
                    begun, before, host, first, run = run >= 0, None, values[0], page, run + 1
                elif not page.copies(first):
                    settle([page], False)
                    before, first, run = last, page, run + 1
                last = page
                waiting.append(((*values, task, run, nth), page))
                nth += 1
                if len(waiting) >= WAITING:
                    settle([], False)
            if done:
                yield batch_of()
        settle([], False)
        yield batch_of()

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(dealt.mapInArrow(number, schema), "lists")
    # One row a task.
    counts = numbered.groupBy("_task").agg((F.max("_run") + 1).alias("count"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"))
    placed = numbered.join(F.broadcast(starts), "_task")
    return placed.withColumn("_place", F.col("_start") + F.col("_run"))


def alignment(lists: DataFrame) -> DataFrame:
    """``_host, _list, _gone, _held`` of every list of lines: which go, and how many shared ones stay.

    Pages that their own task can't settle meet the nearest page of ever more runs on both
    sides, until one tells or their host has no more. Rows of such a join grow with the reach,
    for the pages that are left.
    """
    placed = _in_url_order(lists)
    settled = placed.select("_host", "_list", "_gone", "_held").filter("_gone IS NOT NULL")
    left = placed.filter("_gone IS NULL").select("_host", "_path", "_list", "_keys", "_place")
    left = stored(left, "left")
    if left.isEmpty():
        return settled
    end = F.struct("_path", "_keys")
    runs = placed.groupBy("_place", "_host").agg(
        F.min_by(end, "_nth").alias("_first"), F.max_by(end, "_nth").alias("_last")
    )
    runs = stored(runs, "runs").withColumnRenamed("_place", "_at")
    schema = StructType([*left.schema.fields, *StructType.fromDDL("_gone array<int>, _held int")])
    reach = REACH
    while not left.isEmpty():
        step = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_step")
        asked = left.select("_host", "_list", "_place", step).filter("_step <> 0")
        met = asked.withColumn("_at", F.col("_place") + F.col("_step")).join(runs, ["_at", "_host"])
        near = F.when(F.col("_step") < 0, F.col("_last")).otherwise(F.col("_first"))
        others = F.collect_list(F.struct("_step", near.alias("page"))).alias("_near")
        found = met.groupBy("_host", "_list").agg(others)

        def settle(batch: pa.RecordBatch, reach: int = reach) -> dict[str, list]:
            rows = {n: batch.column(n) for n in batch.schema.names if n != "_near"}
            results = []
            for keys, path, near in zip(
                *(batch.column(n).to_pylist() for n in ("_keys", "_path", "_near")), strict=True
            ):
                sides: tuple[list[Page], list[Page]] = ([], [])
                for other in sorted(near or [], key=lambda o: abs(o["_step"])):
                    sides[other["_step"] > 0].append(Page(other["page"]["_keys"], other["page"]["_path"]))
                ends = tuple(len(side) < reach for side in sides)
                results.append(deleted(Page(keys, path), *sides, ends) or (None, None))
            return rows | {"_gone": [r[0] for r in results], "_held": [r[1] for r in results]}

        given = left.join(found, ["_host", "_list"], "left").select(*left.columns, "_near")
        tried = stored(arrow_map(given, settle, schema), "tried")
        settled = settled.union(tried.filter("_gone IS NOT NULL").select(*settled.columns))
        left = tried.filter("_gone IS NULL").select(*left.columns)
        reach *= GROWTH
    return settled


def _lists(parsed: DataFrame) -> DataFrame:
    """Equal lists of lines of a host once, under the first of their paths."""
    places = {"_host": url_host(F.col("url")), "_path": url_path(F.col("url"))}
    rows = parsed.filter("length(_keys) > 0").withColumns(places)
    once = rows.groupBy("_host", "_list")
    return once.agg(F.min("_path").alias("_path"), F.first("_keys").alias("_keys"))


def _alike(a: str, b: str) -> int:
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))


@other_columns_aside("url", "html")
def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (``url, html`` and others) without ``html``, plus ``text, n_chars``.

    Blocks have character references decoded, white space turned into one space and ends
    trimmed, and are joined by a space in page order; nothing else is dropped or cut. Null or
    empty html and pages without text give an empty text; a null url has an empty host and
    path. Lines of a marked article stay. Of two equally near pages the nearer one in the order
    of paths counts, then the one before; pages of a host without others but near copies keep
    their lines, and so do pages of which no other page leaves a line. Repeated pages stay
    repeated; columns called like the added ones are replaced, others are kept.
    """
    pages = pages.drop("text", "n_chars")
    kept = [c for c in pages.columns if c != "html"]
    parsed = stored(_parsed(pages), "parsed")
    done = parsed.filter("_text IS NOT NULL").select(*kept, F.col("_text").alias("text"))
    aligned = stored(alignment(_lists(parsed)), "aligned")
    open_ = parsed.filter("_text IS NULL").withColumn("_host", url_host(F.col("url")))
    open_ = open_.join(aligned.filter("size(_gone) > 0"), ["_host", "_list"], "left")
    schema = StructType([*pages.select(*kept).schema.fields, *StructType.fromDDL("text string")])

    def difference(batch: pa.RecordBatch) -> dict[str, list]:
        columns = {n: batch.column(n) for n in batch.schema.names}
        texts = []
        for lines, gone in zip(columns["_lines"].to_pylist(), columns["_gone"].to_pylist(), strict=True):
            out = set(gone or ())
            texts.append(" ".join(line for k, line in enumerate(lines) if k not in out))
        return {c: columns[c] for c in kept} | {"text": texts}

    rest = arrow_map(open_.select(*kept, "_lines", "_gone"), difference, schema)
    return done.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
