"""A byte-pair vocabulary with byte fallback as a deterministic transducer that counts tokens.

The encoding of a text's prefix is unique, so reading left to right each position has
one last token: the piece that ends there and may follow the last token of the place
where it starts. Two tokens may follow each other if undoing their merges, latest
first, never meets a pair that would have been merged across the border before.

A state is what later steps can depend on: the last characters, as far as they start
some piece, and for each place among them the last token and the count so far relative
to now. Reading a character gives the next state and the change of the count. States
and transitions are made when first met and kept in a table, which is emptied when it
reaches its limit, as lazily built automata do.

Long texts are cut into chunks. Where a chunk starts at a word's start its entry state
is known; elsewhere it is guessed from the characters before. All chunks run side by
side; each gives a map from its entry to its exit state with a count. Scanning the maps
in order, chunks whose entry isn't the exit of the chunk before are run again from that
state, until all maps compose.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = "▁"
START = -1
CHUNK, LOOK_BACK = 256, 24
#: Characters that are processed at a time, whatever the length of a text.
SLICE = 1 << 19
#: Slots for transitions; the table starts anew when half of them are filled.
SLOTS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in the order of their merges, single characters first."""

    pieces: tuple[str, ...]
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def from_scores(cls, scores: dict[str, float]) -> Vocabulary:
        """Keeps the pieces that merging can make, each with the pair that makes it last."""
        order = sorted(scores, key=lambda p: (len(p) > 1, -scores[p], p))
        rank: dict[str, int] = {}
        left: list[int] = []
        right: list[int] = []
        made: dict[tuple[int, int], int] = {}
        for piece in order:
            own = len(left)
            if len(piece) == 1:
                pair = (own, own)
            else:
                halves = ((rank.get(piece[:k]), rank.get(piece[k:])) for k in range(1, len(piece)))
                pair = next(
                    (
                        (a, b)
                        for a, b in halves
                        if a is not None and b is not None and follows(a, b, left, right, made)
                    ),
                    None,
                )
                if pair is None:
                    continue
                made[pair] = own
            rank[piece] = own
            left.append(pair[0])
            right.append(pair[1])
        return cls(tuple(rank), np.array(left, np.int32), np.array(right, np.int32))


def follows(a: int, b: int, left: list[int], right: list[int], made: dict) -> bool:
    """Whether no merge across the border of tokens ``a`` and ``b`` comes before their own."""
    limit = len(left) + 1
    while True:
        if made.get((a, b), limit) < limit:
            return False
        # Undo the later merge; of equal ones the left one came first.
        if (a > b or left[b] == b) and left[a] != a:
            limit, a = a, right[a]
        elif left[b] != b:
            limit, b = b + 1, left[b]
        else:
            return True


class Transducer:
    """Counts tokens of many texts at once; one per worker process."""

    def __init__(self, vocabulary: Vocabulary, slots: int = SLOTS):
        self.left, self.right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self.rank = {p: k for k, p in enumerate(vocabulary.pieces)}
        self.made = {
            (self.left[k], self.right[k]): k for k, p in enumerate(vocabulary.pieces) if len(p) > 1
        }
        self.starts = {p[:k] for p in vocabulary.pieces for k in range(1, len(p) + 1)}
        self.characters = sorted({c for p in vocabulary.pieces for c in p} | {SPACE})
        if any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces):
            raise ValueError("a piece with a space behind other characters")
        self.symbols = len(self.characters) + 4
        self.symbol_of = np.empty(0x110000, np.int32)
        for width, (low, high) in enumerate(
            ((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000))
        ):
            self.symbol_of[low:high] = len(self.characters) + width
        self.symbol_of[[ord(c) for c in self.characters]] = np.arange(len(self.characters))
        # A character that only occurs inside pieces stands for its bytes when it stays alone.
        self.bytes_of = [len(c.encode()) if c not in self.rank else 0 for c in self.characters]
        self.space = self.characters.index(SPACE)
        self.symbol_of[ord(" ")] = self.space
        self.follow_memo: dict[tuple[int, int], bool] = {}
        self.slots = slots
        self._empty()

    def _empty(self) -> None:
        self.keys = np.full(self.slots, -1, np.int64)
        self.next = np.zeros(self.slots, np.int32)
        self.change = np.zeros(self.slots, np.int32)
        self.filled = 0
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self._state(("", (START,), (0,)))

    def _state(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def _follows(self, a: int, b: int) -> bool:
        known = self.follow_memo.get((a, b))
        if known is None:
            if len(self.follow_memo) > 2_000_000:
                self.follow_memo.clear()
            known = follows(a, b, self.left, self.right, self.made)
            self.follow_memo[a, b] = known
        return known

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The state after one more symbol, and by how much the count changes."""
        fresh = ("", (START,), (0,))
        if symbol >= len(self.characters):
            return fresh, symbol - len(self.characters) + 1
        seen, tokens, counts = state
        character = self.characters[symbol]
        if symbol == self.space and seen and seen[-1] != SPACE:
            seen, tokens, counts = fresh
        text = seen + character
        for start in range(len(text)):
            token = self.rank.get(text[start:])
            if token is not None and (
                tokens[start] == START or self._follows(tokens[start], token)
            ):
                change = counts[start] + 1
                break
        else:
            return fresh, self.bytes_of[symbol]
        keep = 0
        while text[keep:] and text[keep:] not in self.starts:
            keep += 1
        counts = tuple(c - change for c in counts[keep:]) + (0,)
        return (text[keep:], tokens[keep:] + (token,), counts), change

    def _grow(self) -> None:
        """Twice the slots, for a slice that meets more new transitions than usual."""
        used = np.flatnonzero(self.keys != -1)
        old = list(zip(self.keys[used].tolist(), self.next[used], self.change[used], strict=True))
        self.keys, self.next, self.change = (
            np.resize(array, 2 * len(array)) for array in (self.keys, self.next, self.change)
        )
        self.keys[:] = -1
        for key, after, change in old:
            at = self._slot(key)
            while self.keys[at] != -1:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.next[at], self.change[at] = key, after, change

    def _learn(self, state: int, symbol: int) -> None:
        after, change = self.step(self.states[state], symbol)
        key = state * self.symbols + symbol
        at = self._slot(key)
        while self.keys[at] != -1:
            if self.keys[at] == key:
                return
            at = (at + 1) % len(self.keys)
        self.keys[at], self.next[at], self.change[at] = key, self._state(after), change
        self.filled += 1

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 7) % len(self.keys)

    def _advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states.astype(np.int64) * self.symbols + symbols
        at = self._slot(keys)
        found = self.keys[at]
        open_ = np.flatnonzero(found != keys)
        while open_.size:
            new = open_[self.keys[at[open_]] == -1]
            if new.size:
                fresh = np.unique(keys[new]).tolist()
                if self.filled + len(fresh) > len(self.keys) * 3 // 4:
                    self._grow()
                    return self._advance(states, symbols)
                for key in fresh:
                    self._learn(*divmod(key, self.symbols))
            open_ = open_[self.keys[at[open_]] != keys[open_]]
            at[open_] = (at[open_] + 1) % len(self.keys)
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return self.next[at], self.change[at]

    def _run(
        self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, entries: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each chunk, all chunks side by side."""
        order = np.argsort(begins - ends, kind="stable")
        at, left = begins[order].copy(), (ends - begins)[order]
        states, counts = entries[order].copy(), np.zeros(len(order), np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, side="left"))
            states[:n], change = self._advance(states[:n], symbols[at[:n] + k])
            counts[:n] += change
        exits, sums = np.empty_like(states), np.empty_like(counts)
        exits[order], sums[order] = states, counts
        return exits, sums

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        group: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if len(text) > SLICE:
                entry = None
                for low in range(0, len(text), SLICE):
                    part = (SPACE if low == 0 else "") + text[low : low + SLICE]
                    sums, entry = self._count([part], entry)
                    totals[k] += sums[0]
            elif text:
                group.append(k)
                size += len(text)
            if group and (size > SLICE or k == len(texts) - 1):
                totals[group] = self._count([SPACE + texts[g] for g in group])[0]
                group, size = [], 0
        return totals.tolist()

    def _count(self, texts: list[str], entry: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Counts of texts, and the last one's exit; ``entry`` is the first one's entry."""
        if self.filled > self.slots // 2:
            self._empty()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[points]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        # Where the entry state is known: texts, words, and what follows a lone character.
        known = np.zeros(len(symbols) + 1, bool)
        spaces = symbols == self.space
        known[1:-1] = (spaces[1:] & ~spaces[:-1]) | (symbols[:-1] >= len(self.characters))
        known[bounds[:-1]] = True
        cuts = np.arange(CHUNK, len(symbols), CHUNK)
        marks = np.flatnonzero(known)
        after = marks[np.minimum(np.searchsorted(marks, cuts), len(marks) - 1)]
        cuts = np.where((after >= cuts) & (after < cuts + CHUNK), after, cuts)
        begins = np.unique(np.concatenate([bounds[:-1], cuts]))
        begins = begins[begins < len(symbols)]
        ends = np.append(begins[1:], len(symbols))
        entries = np.zeros(len(begins), np.int32)
        guessed = np.flatnonzero(~known[begins])
        if guessed.size:
            text_start = bounds[np.searchsorted(bounds, begins[guessed], side="right") - 1]
            warm = np.maximum(begins[guessed] - LOOK_BACK, text_start)
            zeros = np.zeros(len(guessed), np.int32)
            entries[guessed], _ = self._run(symbols, warm, begins[guessed], zeros)
        if entry is not None:
            entries[0] = self._state(entry)
        exits, counts = self._run(symbols, begins, ends, entries)
        while guessed.size:
            wrong = guessed[exits[guessed - 1] != entries[guessed]]
            if not wrong.size:
                break
            entries[wrong] = exits[wrong - 1]
            exits[wrong], counts[wrong] = self._run(
                symbols, begins[wrong], ends[wrong], entries[wrong]
            )
        owner = np.searchsorted(bounds, begins, side="right") - 1
        sums = np.bincount(owner, counts, len(texts)).astype(np.int64)
        return sums, self.states[exits[-1]]
