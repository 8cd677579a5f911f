"""A line as words: what each looks like, which cue phrases stand among them, and the values that can be read beside a cue.

Rules of detection never search a line themselves. The words are cut once; cues are found in one walk over them by a
table of first words; readers then take a name, a place, a code or a number at a given word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

_WORD = re.compile(r"[^\W_]+(?:['’.\-/][^\W_]+)*")
#: What may stand between a cue and its value.
_LINK = re.compile(r"(?:\s*(?:number|num|no|n[uú]mero|id|#)(?![^\W_])\.?)?\s*(?:is(?!\w)|[=:#\-]+)?[\s_*`]*", re.IGNORECASE)
#: Small words inside names of people and places.
PARTICLES = frozenset("al bin binti da das de del della der des di dos du el la las le los of the van von y".split())

Span = tuple[int, int]


class Hit(NamedTuple):
    cue: str
    first: int  # word
    last: int  # word behind it
    start: int
    end: int


class Words:
    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.low = [w.casefold() for w in self.words]

    def __len__(self) -> int:
        return len(self.spans)

    def gap(self, k: int) -> str:
        """Text between word k and the one before (or the line's begin)."""
        return self.text[self.spans[k - 1][1] if k else 0 : self.spans[k][0]]

    def named(self, k: int) -> bool:
        """Whether word k begins with a capital and holds no digit."""
        w = self.words[k]
        return w[0].isupper() and not any(map(str.isdigit, w))

    def at(self, place: int) -> int | None:
        """The word that begins at a place of the text."""
        for k, (a, _) in enumerate(self.spans):
            if a >= place:
                return k if a == place else None
        return None

    def after(self, hit: Hit) -> int | None:
        """The word of a value that a cue announces, behind ``number``, ``is``, a colon and the like."""
        return self.at(_LINK.match(self.text, hit.end).end())

    # --- readers: the span of a value that begins at word k, or None ---

    def run(self, k: int | None, most: int) -> Span | None:
        """Capitalised words in a row, particles between them included."""
        if k is None or k >= len(self) or not self.named(k):
            return None
        last = k
        j = k + 1
        while j < len(self) and j - k < most + 3:
            gap = self.gap(j)
            if gap.strip() and not (gap.strip() == "." and len(self.words[j - 1]) == 1):
                break
            if self.named(j):
                last = j
            elif self.low[j] not in PARTICLES:
                break
            j += 1
        while sum(map(self.named, range(k, last + 1))) > most:
            last -= 1
        while not self.named(last):
            last -= 1
        return self.spans[k][0], self.spans[last][1]

    def code(self, k: int | None, low: int = 5, high: int = 24) -> Span | None:
        """A code with a digit: one word, or groups of digits parted by one space."""
        if k is None or k >= len(self):
            return None
        a, b = self.spans[k]
        if self.words[k].replace("-", "").isdigit():
            j = k + 1
            while j < len(self) and j - k < 4 and self.gap(j) in (" ", "-") and self.words[j].replace("-", "").isdigit():
                b = self.spans[j][1]
                j += 1
        value = self.text[a:b]
        return (a, b) if low <= sum(c.isascii() and c.isalnum() for c in value) <= high and any(map(str.isdigit, value)) else None

    def codes(self) -> Iterator[Span]:
        behind = 0
        for k in range(len(self)):
            if self.spans[k][0] >= behind and (span := self.code(k)):
                behind = span[1]
                yield span

    def number(self, k: int | None) -> int | None:
        if k is None or k >= len(self):
            return None
        digits = re.match(r"\d{1,3}(?!\d)", self.words[k])
        return int(digits[0]) if digits else None


def nearest(spans: Iterable[Span], hit: Hit, after: int, before: int) -> Span | None:
    """The first span that begins up to ``after`` characters behind a cue, else the last that ends up to ``before`` ahead of it."""
    behind = None
    for a, b in spans:
        if hit.end <= a <= hit.end + after:
            return a, b
        if b <= hit.start <= b + before:
            behind = (a, b)
    return behind


class Cues:
    """Cue phrases by name, found by their first word; the longest phrase at a place counts, for all names that have it."""

    def __init__(self, phrases: dict[str, Iterable[str]]):
        self.by_first: dict[str, list[tuple[tuple[str, ...], list[str]]]] = {}
        names: dict[tuple[str, ...], list[str]] = {}
        for name, own in phrases.items():
            for phrase in own:
                names.setdefault(tuple(phrase.casefold().split()), []).append(name)
        for words in sorted(names, key=len, reverse=True):
            self.by_first.setdefault(words[0], []).append((words, names[words]))

    def find(self, w: Words) -> dict[str, list[Hit]]:
        out: dict[str, list[Hit]] = {}
        for k, first in enumerate(w.low):
            for words, names in self.by_first.get(first, ()):
                n = len(words)
                if tuple(w.low[k : k + n]) == words and all(w.gap(j).strip() in ("", "-") for j in range(k + 1, k + n)):
                    for name in names:
                        out.setdefault(name, []).append(Hit(name, k, k + n, w.spans[k][0], w.spans[k + n - 1][1]))
                    break
        return out
