"""Dense features of texts, from counts of character classes, words and lines."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Container, Mapping
from functools import lru_cache

import numpy as np

UPPER, LOWER, DIGIT, SPACE, SYMBOL, OTHER = range(6)
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~^+=/\\…«»“”„"

#: Words that address someone.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine euch euer ihr "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split()
)
#: Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi", "*")
OBFUSCATED = re.compile(r"[^\W\d_][*@$!0-9]+[^\W\d_]")

QUALITY_FEATURES = (
    "log_words",
    "mean_word",
    "upper_share",
    "digit_share",
    "symbol_share",
    "symbols_per_word",
    "symbol_ended_words",
    "exclamations_per_word",
    "bare_symbol_words",
    "distinct_words",
    "repeated_neighbours",
    "top_word_share",
    "top_long_word_share",
    "distinct_lines",
    "words_per_line",
    "distinct_triples",
)
TOXICITY_FEATURES = (
    "log_words",
    "lexicon_density",
    "log_lexicon_hits",
    "largest_weight",
    "weight_per_word",
    "masked_hits",
    "second_person_density",
    "second_person_near_hits",
    "upper_share",
    "capital_words",
    "symbol_share",
    "exclamations_per_word",
    "obfuscated_words",
    "mean_word",
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point below 0x3000; all above are OTHER or letters."""
    table = np.full(0x110000, LOWER, np.uint8)
    for point in range(0x3000):
        kind = unicodedata.category(chr(point))
        table[point] = (
            UPPER
            if kind in ("Lu", "Lt")
            else LOWER
            if kind[0] in "LM"
            else DIGIT
            if kind[0] == "N"
            else SPACE
            if kind[0] == "Z" or chr(point).isspace()
            else SYMBOL
            if kind[0] in "PS"
            else OTHER
        )
    return table


def class_counts(text: str) -> np.ndarray:
    """How many characters of each class a text has; long texts in parts."""
    counts = np.zeros(6, np.int64)
    for low in range(0, len(text), 1 << 20):
        part = text[low : low + (1 << 20)]
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        counts += np.bincount(_classes()[points], minlength=6)
    return counts


def quality_features(text: str) -> list[float]:
    """One value for each of ``QUALITY_FEATURES``; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(QUALITY_FEATURES)
    counts = class_counts(text)
    marks = max(1, len(text) - int(counts[SPACE]))
    often = Counter(words)
    letters = sum(map(len, words))
    neighbours = sum(a == b for a, b in zip(words, words[1:], strict=False))
    triples = max(1, n - 2)
    lines = [line for line in text.split("\n") if line.strip()]
    long_words = [c for w, c in often.items() if len(w) > 3]
    return [
        float(np.log1p(n)),
        letters / n,
        counts[UPPER] / max(1, counts[UPPER] + counts[LOWER]),
        counts[DIGIT] / marks,
        counts[SYMBOL] / marks,
        counts[SYMBOL] / n,
        sum(c for w, c in often.items() if w[-1] in "*#$%&|!") / n,
        text.count("!") / n,
        sum(c for w, c in often.items() if w in "|*#$%&-=~_+") / n,
        len(often) / n,
        neighbours / max(1, n - 1),
        max(often.values()) / n,
        max(long_words, default=0) / n,
        len(set(lines)) / len(lines),
        min(200.0, n / len(lines)),
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples if n > 2 else 1.0,
    ]


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


def forms(word: str) -> tuple[str, ...]:
    """What a lexicon knows a word by: itself, and its beginnings with a ``~``.

    A word of more than 64 characters, such as a text without spaces, is known by its
    beginnings only, which keeps a lexicon small.
    """
    own = (word,) if len(word) <= 64 else ()
    return (*own, *(word[:k] + "~" for k in (4, 5, 6, 7) if len(word) > k))


class Lexicon:
    """Weights of words and beginnings; remembers the words it has met lately."""

    LIMIT, LONGEST = 200_000, 64

    def __init__(self, weights: Mapping[str, float]):
        self.weights = dict(weights)
        self.known: dict[str, tuple[float, bool, bool, bool, bool]] = {}

    def look_up(self, token: str) -> tuple[float, bool, bool, bool, bool]:
        """Weight (0: none), met only unmasked, second person, in capitals, obfuscated."""
        found = self.known.get(token)
        if found is None:
            word = bare(token)
            weight, masked = self._weight(word), False
            obfuscated = bool(OBFUSCATED.search(token))
            if not weight and obfuscated:
                weight = self._weight(word.translate(LOOKALIKES))
                masked = weight > 0
            capital = len(word) > 1 and token.isupper()
            found = weight, masked, word in SECOND_PERSON, capital, obfuscated
            if len(token) <= self.LONGEST:
                if len(self.known) >= self.LIMIT:
                    self.known.clear()
                self.known[token] = found
        return found

    def _weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in forms(word)), default=0.0)


def toxicity_features(text: str, lexicon: Lexicon, near: int = 5) -> list[float]:
    """One value for each of ``TOXICITY_FEATURES``; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(TOXICITY_FEATURES)
    # Each different word is looked up once; most say nothing.
    hits, people = {}, set()
    masks = persons = capitals = obfuscations = 0
    for word, often in Counter(words).items():
        weight, masked, person, capital, obfuscated = lexicon.look_up(word)
        if weight:
            hits[word] = weight
            masks += often * masked
        if person:
            people.add(word)
            persons += often
        capitals += often * capital
        obfuscations += often * obfuscated
    weights = [hits[w] for w in words if w in hits] if hits else []
    close = _near(words, hits, people, near) if hits and people else 0
    counts = class_counts(text)
    marks = max(1, len(text) - int(counts[SPACE]))
    return [
        float(np.log1p(n)),
        len(weights) / n,
        float(np.log1p(len(weights))),
        max(weights, default=0.0),
        sum(weights) / n,
        masks / n,
        persons / n,
        close / max(1, len(weights)),
        counts[UPPER] / max(1, counts[UPPER] + counts[LOWER]),
        capitals / n,
        counts[SYMBOL] / marks,
        text.count("!") / n,
        obfuscations / n,
        (len(text) - int(counts[SPACE])) / n,
    ]


def _near(words: list[str], hits: Container[str], people: Container[str], near: int) -> int:
    """How many hits have a word that addresses someone at most ``near`` words away."""
    at = np.array([k for k, w in enumerate(words) if w in hits])
    others = np.array([k for k, w in enumerate(words) if w in people])
    low, high = (np.searchsorted(others, at + d, s) for d, s in ((-near, "left"), (near, "right")))
    return int((high > low).sum())
