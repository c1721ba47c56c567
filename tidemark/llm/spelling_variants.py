"""Operator 11, spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words are one inserted, deleted or replaced code point apart if their common prefix and
common suffix together reach the longer one's length less one. Words meet in groups that
agree outside a window of places: the edit lies in the first or in the second half of the
longer word, so both halves are posted, for the word as the longer and as the shorter one of
a pair. A group of more than ``GROUP`` words has its window halved again, with what then lies
outside added to the key, until groups are small or the window is one place, where a group
holds no more words than there are letters. So no group grows with the vocabulary, and no
pair is lost: a pair's edit lies in one half of every window that holds it.

Tasks sort their groups, cut them into tiles and compare pairs of blocks as padded matrices
of code points. A pair is taken only where its window holds the first place at which the two
differ, which is so in one group. Tasks give a row for each word, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare_workers, stored

#: Words of a group that is compared as it is, rows and code points of a block, of a task's share.
GROUP, BLOCK, BLOCK_POINTS = 2048, 128, 1 << 21
SHARE_ROWS, SHARE_POINTS = 65_536, 1 << 23

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "word string, n_near long, form string, form_n long"


def letter_runs(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """``docs`` without ``text``, a row for each run of letters, lower-cased, in ``run``.

    Runs are maximal ones of A-Z, a-z and U+00C0 to U+00FF in whole texts, of at least
    ``least_length`` code points; only A-Z are lower-cased. Null texts have none.
    """
    letters = F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}")
    others = [c for c in docs.columns if c not in ("text", "run")]
    runs = docs.select(*others, F.explode(F.regexp_extract_all("text", letters, F.lit(0))).alias("run"))
    # A run that full lower-casing leaves alone has no capital, and most have none.
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run"))
    return runs.withColumn("run", lowered.otherwise(F.translate("run", UPPER, LOWER)))


def word_counts(words: Column, rows: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """``word, n``: the distinct values of ``words`` that are long and frequent enough."""
    listed = rows.select(words.alias("word")).filter(F.length("word") >= least_length)
    counted = listed.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words`` (word, n).

    ``n_near`` counts the words one edit away. ``form`` is the one of largest ``n`` among
    them (ties: first in code-point order) if that is at least ``ratio`` times the word's
    own, with its count in ``form_n``, else both are null. ``root`` is where following
    forms ends, the word itself if it has none.

    A word that is given twice counts once, with the larger ``n``; null and empty words and
    null counts are left out. Other columns are ignored, and no rows give none. Words may
    be of any length: tiles are bounded by code points.
    """
    if ratio < 2:
        raise ValueError("forms end only where each is more frequent than its word")
    given = words.select("word", F.col("n").cast("long").alias("n"))
    given = given.filter("n IS NOT NULL AND word <> ''").groupBy("word").agg(F.max("n").alias("n"))
    given = stored(given, "words")
    near = (
        _compared(_groups(given))
        .groupBy("word")
        .agg(
            F.sum("n_near").alias("n_near"),
            F.min(F.struct((-F.col("form_n")).alias("rank"), "form")).alias("best"),
        )
    )
    counted = given.join(near, "word", "left")
    often = -F.col("best.rank") >= ratio * F.col("n")
    judged = counted.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.form")).alias("form"),
        F.when(often, -F.col("best.rank")).alias("form_n"),
    )
    judged = stored(judged, "variants")
    roots = _roots(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _window(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """``rows`` (word, n, longer, shorter) in the groups of a window of the longer word.

    Groups are told by a hash. Two that share one are compared needlessly and no more,
    since every pair is confirmed on its words and windows.
    """
    placed = rows.withColumns({"low": low, "high": high}).filter("low < high")
    before = F.expr("substring(word, 1, low)")
    after = F.expr("substring(word, high - IF(shorter, 1, 0) + 1)")
    return placed.withColumn("group", F.xxhash64("longer", "low", "high", before, after))


def _groups(words: DataFrame) -> list[DataFrame]:
    """Rows of words in groups that may hold pairs, none too large to be compared."""
    length = F.length("word")
    sides = F.explode(F.array(*(F.struct((length + k).alias("longer"), F.lit(k == 1).alias("shorter")) for k in (0, 1))))
    rows = words.select("word", "n", sides.alias("side")).select("word", "n", "side.*")
    half = F.expr("longer div 2").cast("int")
    found = []
    rows = _window(rows, F.lit(0), half).union(_window(rows, half, F.col("longer")))
    while True:
        rows = stored(rows, "windows")
        sizes = rows.groupBy("group").agg(
            F.count("*").alias("members"), F.count_if(~F.col("shorter")).alias("whole")
        )
        # A pair needs one word of the full length.
        sizes = sizes.filter("members > 1 AND whole > 0")
        meeting = stored(rows.join(sizes.drop("whole"), "group"), "groups")
        large = (F.col("members") > GROUP) & (F.col("high") - F.col("low") > 1)
        found.append(meeting.filter(~large).drop("members"))
        rest = meeting.filter(large).drop("members")
        if not rest.limit(1).count():
            return found
        middle = F.expr("(low + high) div 2").cast("int")
        columns = ["word", "n", "longer", "shorter"]
        kept = rest.select(*columns, F.col("low").alias("_low"), F.col("high").alias("_high"), middle.alias("_middle"))
        parts = [
            _window(kept, F.col(a), F.col(b)).select(*columns, "low", "high", "group")
            for a, b in (("_low", "_middle"), ("_middle", "_high"))
        ]
        rows = parts[0].union(parts[1])


def _compared(groups: list[DataFrame]) -> DataFrame:
    """``word, n_near, form, form_n``: of each word's row in a share, the near words there."""
    columns = ["group", "word", "n", "longer", "shorter", "low", "high"]
    rows = groups[0].select(*columns)
    for more in groups[1:]:
        rows = rows.union(more.select(*columns))
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("word").cast("long")), F.lit(0))).first()
    shares = 1 + max(size[0] // SHARE_ROWS, size[1] // SHARE_POINTS)
    prepare_workers(rows.sparkSession)
    dealt = rows.select(F.pmod(F.xxhash64("group"), F.lit(shares)).alias("share"), *columns)
    return dealt.groupBy("share").applyInArrow(_compare, _FOUND)


def _compare(share: pa.Table) -> pa.Table:
    """A row for each row of ``share`` that has near words in its group."""
    share = share.sort_by([("longer", "ascending"), ("group", "ascending")])
    words = share.column("word").to_pylist()
    often, group, longer, low, high = (
        share.column(c).to_numpy() for c in ("n", "group", "longer", "low", "high")
    )
    tiles = _Tiles(words)
    pairs = [(np.empty(0, np.intp),) * 2]
    for first, second in _block_pairs(group, longer):
        i, j, prefix = tiles.near(first, second, group)
        whole = np.maximum(tiles.lengths[i], tiles.lengths[j])
        place = np.minimum(prefix, whole - 1)
        keep = (longer[i] == longer[j]) & (low[i] == low[j]) & (high[i] == high[j])
        keep &= (whole == longer[i]) & (low[i] <= place) & (place < high[i])
        pairs.append((i[keep], j[keep]))
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    here, there = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[there], -often[there], here))
    row, first, counts = np.unique(here[order], return_index=True, return_counts=True)
    best = there[order][first]
    column = share.column("word")
    arrays = [column.take(pa.array(row)), pa.array(counts, pa.int64())]
    arrays += [column.take(pa.array(best)), pa.array(often[best], pa.int64())]
    return pa.Table.from_arrays(arrays, names=["word", "n_near", "form", "form_n"])


def _block_pairs(group: np.ndarray, longer: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Blocks of rows, sorted by group, that have to be compared: every group with itself.

    Small groups share a block; a group of more than one has all pairs of its blocks.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    ends = [*starts[1:], len(group)]
    at = 0
    for low, high in zip(starts, ends, strict=False):
        rows = int(max(2, min(BLOCK, BLOCK_POINTS // int(longer[high - 1]))))
        if high - low > rows:
            if at < low:
                yield slice(at, low), slice(at, low)
            blocks = [slice(k, min(k + rows, high)) for k in range(low, high, rows)]
            for k, block in enumerate(blocks):
                yield from ((block, other) for other in blocks[k:])
            at = high
        elif high - at > rows:
            yield slice(at, low), slice(at, low)
            at = low
    if at < len(group):
        yield slice(at, len(group)), slice(at, len(group))


class _Tiles:
    """Words as rows of padded code-point matrices."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.lengths)
        points = "".join(words).encode("utf-32-le")
        self.points = np.frombuffer(points, np.uint32)

    def _matrices(self, rows: slice, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns from the words' starts, and from their ends; ``pad`` is no code point."""
        lengths, ends = self.lengths[rows], self.ends[rows]
        places = np.arange(width)[:, None]
        inside = places < lengths
        starts = ends - lengths
        forward = np.where(inside, self.points[np.where(inside, starts + places, 0)], pad)
        backward = np.where(inside, self.points[np.where(inside, ends - 1 - places, 0)], pad)
        return forward, backward

    def near(self, a: slice, b: slice, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """``i, j, prefix`` of the pairs of one group whose words are one edit apart."""
        width = int(max(self.lengths[a].max(), self.lengths[b].max()))
        left, right = self._matrices(a, width, 0x110000), self._matrices(b, width, 0x110001)
        meet = group[a][:, None] == group[b][None, :]
        if a == b:
            meet = np.triu(meet, 1)
        prefix, suffix = (_agreement(x, y, meet) for x, y in zip(left, right, strict=True))
        whole = np.maximum(self.lengths[a][:, None], self.lengths[b][None, :])
        i, j = np.nonzero(meet & (prefix + suffix >= whole - 1))
        return i + a.start, j + b.start, prefix[i, j]


def _agreement(left: np.ndarray, right: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """How many columns of each pair of words agree before the first that doesn't."""
    alive, count = meet.copy(), np.zeros(meet.shape, np.int32)
    for x, y in zip(left, right, strict=True):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        count += alive
    return count


def _roots(steps: DataFrame) -> DataFrame:
    """``word, root``, where each word's ``root`` is followed to the end, by doubling.

    Every step leads to a word at least twice as frequent, so there are no circles, and
    rounds grow with the logarithm of the logarithm of the largest count.
    """
    steps = stored(steps, "roots")
    while True:
        above = steps.select(F.col("word").alias("root"), F.col("root").alias("_above"))
        moved = steps.join(above, "root", "left").select(
            "word", F.coalesce("_above", "root").alias("root"), F.col("_above").isNotNull().alias("_moved")
        )
        moved = stored(moved, "roots")
        steps = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            return steps
