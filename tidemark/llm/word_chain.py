"""A linear-chain conditional random field over words, with hashed features of their letters.

A word's features are its grams of two to four code points with marks for its start and end
(so its affixes as well) and the whole word. Weights and transitions are fitted together by
the likelihood of labelled sequences, with forward and backward sums over all paths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

START, END = 2, 3
GRAMS = (2, 3, 4)
BITS = 17
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)
#: Log odds of a word's labels, and of transitions, stay in these bounds: sums can't underflow.
WORD_ODDS, STEP_ODDS = 25.0, 12.0
#: Words of a chunk, chunks and distinct words that are worked on at a time.
CHUNK, CHUNKS, WORDS = 32, 8192, 32_768
EPOCHS, RATE, SHRINK = 40, 0.15, 1e-4


def _grams(words: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket numbers of all features at each place of the words, and where words start.

    The last bucket stands for no feature.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    joined = chr(END) + "".join(chr(START) + w + chr(END) for w in words)
    points = np.frombuffer(joined[1:].encode("utf-32-le"), np.uint32).astype(np.uint64)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))
    none = 1 << BITS
    found, gram = [], np.zeros(len(points), np.uint64)
    for size in range(1, max(GRAMS) + 1):
        after = np.zeros(len(points), np.uint64)
        after[: len(points) - size + 1] = points[size - 1 :]
        gram = gram * _BASE + after
        if size in GRAMS:
            found.append(np.where(left >= size, _bucket(gram + np.uint64(size)), none))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max()) - 1, _BASE)], dtype=np.uint64)
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    whole = np.full(len(points), none)
    whole[starts] = _bucket(np.add.reduceat(points * powers[place], starts))
    return [*found, whole], starts, lengths


def _bucket(values: np.ndarray) -> np.ndarray:
    mixed = values * _MIX
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class WordChain:
    """Labels in their order, feature weights, and scores of starts and of steps between labels."""

    labels: list[str]
    weights: np.ndarray
    start: np.ndarray
    steps: np.ndarray

    def evidence(self, words: Sequence[str]) -> np.ndarray:
        """How much each word speaks for each label, the largest of a word being 1."""
        parts = [self._scores(words[k : k + WORDS]) for k in range(0, len(words), WORDS)]
        scores = np.concatenate(parts) if parts else np.empty((0, len(self.labels)))
        return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -WORD_ODDS))

    def _scores(self, words: Sequence[str]) -> np.ndarray:
        buckets, starts, lengths = _grams(words)
        sums = sum(np.add.reduceat(self.weights[b], starts) for b in buckets)
        return sums / np.sqrt(lengths)[:, None]

    def marginals(
        self, words: np.ndarray, sizes: np.ndarray, evidence: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The chance of each label for each word of many sequences, some thousand chunks at a time.

        ``words`` are numbers of rows in ``evidence``, all sequences one after the other, and
        ``sizes`` their lengths. Gives places in ``words`` and the chances there. Chunks are
        summed up as matrices first, which gives what enters each of them from both sides.
        """
        moves = np.exp(self.steps)
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begins = (np.cumsum(sizes) - sizes)[owner] + nth * CHUNK
        filled = np.minimum(sizes[owner] - nth * CHUNK, CHUNK)
        sections = [slice(k, k + CHUNKS) for k in range(0, len(owner), CHUNKS)]
        place = np.arange(CHUNK)

        def placed(part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            inside = place < filled[part][:, None]
            at = np.where(inside, begins[part][:, None] + place, 0)
            return at, inside, evidence[words[at]]

        sums = [_chunk_sums(*placed(p)[1:], nth[p] == 0, moves) for p in sections]
        if not sums:
            return
        before, behind = _entries(np.concatenate(sums), chunks, np.exp(self.start))
        for part in sections:
            at, inside, given = placed(part)
            chances = _chunk_chances(given, inside, nth[part] == 0, moves, before[part], behind[part])
            yield at[inside], chances[inside]


def _unit(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=-1, keepdims=True)


def _chunk_sums(inside: np.ndarray, given: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The sum over all paths through each chunk, from each label before to each at its end."""
    count, _, k = given.shape
    sums = np.broadcast_to(np.eye(k), (count, k, k)).copy()
    for t in range(given.shape[1]):
        if not inside[:, t].any():
            break
        moved = (sums.reshape(-1, k) @ moves).reshape(sums.shape)
        if t == 0:
            # Nothing comes before a sequence's first word.
            moved[first] = sums[first]
        moved *= given[:, t, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        sums = np.where(inside[:, t, None, None], moved, sums)
    return sums


def _entries(sums: np.ndarray, chunks: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each chunk from the words before it, and from those behind it."""
    before, behind = (np.ones(sums.shape[:2]) for _ in range(2))
    heads = np.cumsum(chunks) - chunks
    before[heads[chunks > 0]] = _unit(start)
    for step in range(1, int(chunks.max(initial=0))):
        at = heads[chunks > step] + step
        before[at] = _unit(np.einsum("ni,nij->nj", before[at - 1], sums[at - 1]))
        at = (heads + chunks)[chunks > step] - step
        behind[at - 1] = _unit(np.einsum("nij,nj->ni", sums[at], behind[at]))
    return before, behind


def _chunk_chances(
    given: np.ndarray, inside: np.ndarray, first: np.ndarray, moves: np.ndarray, before: np.ndarray, behind: np.ndarray
) -> np.ndarray:
    """The chance of each label at each place of the chunks."""
    forward = np.empty_like(given)
    state = before
    for t in range(given.shape[1]):
        moved = state @ moves
        if t == 0:
            moved[first] = state[first]
        state = np.where(inside[:, t, None], _unit(moved * given[:, t]), state)
        forward[:, t] = state
    state = behind
    for t in reversed(range(given.shape[1])):
        forward[:, t] *= state
        state = np.where(inside[:, t, None], _unit((state * given[:, t]) @ moves.T), state)
    return _unit(forward)


def fit(labels: Sequence[str], words: Sequence[str], ids: np.ndarray, marks: np.ndarray) -> WordChain:
    """A chain from sequences, a row each, of numbers in ``words`` and in ``labels``.

    Both are -1 behind a sequence's end. Adam on the whole likelihood, with weights that
    shrink a little; the same rows give the same chain.
    """
    k = len(labels)
    chain = WordChain(list(labels), np.zeros(((1 << BITS) + 1, k)), np.zeros(k), np.zeros((k, k)))
    if not len(ids) or k < 2:
        return chain
    buckets, starts, lengths = _grams(words)
    scale = 1 / np.sqrt(lengths)[:, None]
    inside = ids >= 0
    known = np.where(inside, ids, 0)
    truth = np.eye(k)[np.where(inside, marks, 0)] * inside[:, :, None]
    both = inside[:, 1:, None]
    told = np.einsum("nti,ntj->ij", truth[:, :-1] * both, truth[:, 1:] * both)
    total = inside.sum()
    used = np.unique(np.concatenate(buckets))
    used = used[used < 1 << BITS]
    states = [np.zeros((2, *shape)) for shape in ((len(used), k), (k,), (k, k))]
    for epoch in range(1, EPOCHS + 1):
        scores = sum(np.add.reduceat(chain.weights[b], starts) for b in buckets) * scale
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -WORD_ODDS)
        chances, moved = _expected(np.exp(scores)[known], inside, chain)
        wrong = (truth - chances) * inside[:, :, None]
        by_word = np.stack(
            [np.bincount(known.ravel(), wrong[:, :, j].ravel(), len(words)) for j in range(k)], axis=1
        )
        by_word *= scale
        slope = np.zeros_like(chain.weights)
        for b in buckets:
            for j in range(k):
                slope[:, j] += np.bincount(b, np.repeat(by_word[:, j], lengths), len(slope))
        slopes = [
            slope[used] / total - SHRINK * chain.weights[used] / 100,
            wrong[:, 0].sum(axis=0) / total - SHRINK * chain.start,
            (told - moved) / total - SHRINK * chain.steps,
        ]
        news = [_adam(s, g, epoch) for s, g in zip(states, slopes, strict=True)]
        chain.weights[used] += news[0]
        chain.start = np.clip(chain.start + news[1], -STEP_ODDS, STEP_ODDS)
        chain.steps = np.clip(chain.steps + news[2], -STEP_ODDS, STEP_ODDS)
    chain.weights = chain.weights.astype(np.float32)
    return chain


def _expected(given: np.ndarray, inside: np.ndarray, chain: WordChain) -> tuple[np.ndarray, np.ndarray]:
    """The chances of labels at all places of sequences, and the expected steps between labels."""
    moves = np.exp(chain.steps)
    size = given.shape[1]
    before = np.broadcast_to(_unit(np.exp(chain.start)), given[:, 0].shape)
    forward = np.empty_like(given)
    state = before
    for t in range(size):
        moved = state if t == 0 else state @ moves
        state = np.where(inside[:, t, None], _unit(moved * given[:, t]), state)
        forward[:, t] = state
    steps = np.zeros_like(moves)
    chances = np.empty_like(given)
    state = np.ones_like(given[:, 0])
    for t in reversed(range(size)):
        chances[:, t] = _unit(forward[:, t] * state)
        ahead = state * given[:, t]
        if t:
            here = forward[:, t - 1]
            mass = np.einsum("ni,ij,nj->n", here, moves, ahead)
            share = np.where(inside[:, t], 1 / mass, 0)[:, None]
            steps += moves * (here.T @ (ahead * share))
        state = np.where(inside[:, t, None], _unit(ahead @ moves.T), state)
    return chances, steps


def _adam(state: np.ndarray, slope: np.ndarray, epoch: int) -> np.ndarray:
    state[0] += 0.1 * (slope - state[0])
    state[1] += 0.01 * (slope * slope - state[1])
    mean, spread = state[0] / (1 - 0.9**epoch), state[1] / (1 - 0.99**epoch)
    return RATE * mean / (np.sqrt(spread) + 1e-10)
