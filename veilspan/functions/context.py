"""Context scores: how far phrases near a candidate speak for or against it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """Phrases with weights, and how their influence decays with the distance in characters."""

    plus: dict[str, float] = field(default_factory=dict)
    minus: dict[str, float] = field(default_factory=dict)
    window: int = 64
    power: float = 1.0
    base: float = 0.55
    abbreviations: bool = True  #: a period after a letter is no hard boundary


HARD, SOFT, SOFT_FACTOR = frozenset(",.;!?\n"), frozenset(":—–"), 0.75
_ABBREVIATION = re.compile(r"(?<=[^\W\d_])\.")


_DIGITS, _CYRILLIC = re.compile("[0-9]+"), re.compile("[А-Яа-яЁё]")


class Doc:
    """A text, its case-folded form of the same length, and where phrases occur in it."""

    __slots__ = ("text", "folded", "_at", "_has_card", "_digits", "_cyrillic")

    def __init__(self, text: str):
        self.text = text
        low = text.lower()
        # a fold that changes the length would shift offsets
        self.folded = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self._at: dict[str, list[int]] = {}
        self._has_card: bool | None = None
        self._digits: tuple[int, int] | None = None
        self._cyrillic: bool | None = None

    @property
    def digits(self) -> tuple[int, int]:
        """How many ASCII digits there are, and how many side by side at most."""
        if self._digits is None:
            runs = [len(r) for r in _DIGITS.findall(self.text)]
            self._digits = sum(runs), max(runs, default=0)
        return self._digits

    @property
    def cyrillic(self) -> bool:
        if self._cyrillic is None:
            self._cyrillic = not self.text.isascii() and _CYRILLIC.search(self.text) is not None
        return self._cyrillic

    def places(self, phrase: str) -> list[int]:
        found = self._at.get(phrase)
        if found is None:
            found, at = [], self.folded.find(phrase)
            while at >= 0:
                found.append(at)
                at = self.folded.find(phrase, at + len(phrase))
            self._at[phrase] = found
        return found


def barrier(between: str, abbreviations: bool = True) -> float:
    """0 across a hard boundary, SOFT_FACTOR across a soft one, else 1."""
    marks = set(between)
    if marks & HARD and (not abbreviations or set(_ABBREVIATION.sub("", between)) & HARD):
        return 0.0
    return SOFT_FACTOR if marks & SOFT else 1.0


def influence(doc: Doc, start: int, end: int, phrases: dict[str, float], rule: Rule) -> float:
    best = 0.0
    for phrase, weight in phrases.items():
        for at in doc.places(phrase):
            stop = at + len(phrase)
            if stop <= start:
                left, right = stop, start
            elif at >= end:
                left, right = end, at
            else:
                continue
            gap = right - left
            if gap > rule.window:
                continue
            passed = barrier(doc.text[left:right], rule.abbreviations)
            if passed:
                best = max(best, weight * (1.0 - gap / (rule.window + 1)) ** rule.power * passed)
    return best


def confidence(doc: Doc, start: int, end: int, rule: Rule) -> float:
    """The base, plus the strongest phrase for the candidate, less the strongest against it, within 0 and 1."""
    return min(1.0, max(0.0, rule.base + influence(doc, start, end, rule.plus, rule) - influence(doc, start, end, rule.minus, rule)))
