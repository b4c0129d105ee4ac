"""Words, numbers, marks and line ends of many texts at once, as arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

SPACE, LINE, LETTER, DIGIT, UNDERSCORE, MARK, INNER = range(7)
PORTION = 1_000_000  # characters that are looked at together

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes; the order counts."""
    return mixed(np.asarray(a, dtype=np.uint64) * _BASE + (np.asarray(b, dtype=np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)))


def number(name: str) -> np.uint64:
    """The hash of a name."""
    return text_hash(name)[0]


def _class(c: str) -> int:
    if c == "\n":
        return LINE
    if c.isspace() or c == "\0" or c == "\x01":
        return SPACE
    if c.isdecimal():
        return DIGIT
    if c == "_":
        return UNDERSCORE
    return LETTER if c.isalnum() else MARK


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class, and whether it is a capital, of every character of the basic plane."""
    chars = [chr(i) for i in range(65536)]
    return np.array([_class(c) for c in chars], dtype=np.uint8), np.array([c.isupper() for c in chars])


def _looked_up(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    classes, capitals = _classes()
    low = np.minimum(points, 65535)
    kind, upper = classes[low], capitals[low]
    far = np.flatnonzero(points > 65535)
    if len(far):
        distinct, at = np.unique(points[far], return_inverse=True)
        kind[far] = np.array([_class(chr(p)) for p in distinct], dtype=np.uint8)[at]
        upper[far] = np.array([chr(p).isupper() for p in distinct])[at]
    return kind, upper


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)]), dtype=np.uint64) for b in (_BASE, _UNBASE)]
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any stretches of a sequence of code points: equal stretches have equal ones, wherever they stand."""

    def __init__(self, points: np.ndarray):
        self.up, down = _power(len(points) + 1)
        value = mixed(points.astype(np.uint64) + np.uint64(1))
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(value * down[: len(points)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """end > start"""
        return mixed((self.total[end] - self.total[start]) * self.up[end - 1])


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def text_hash(text: str) -> np.ndarray:
    p = points_of(text)
    return Rolling(p).of(np.array([0]), np.array([len(p)]))


class Tokens:
    """The tokens of texts: of, the text that each stands in; start and end; exact, a hash of the token; kind.

    A token is a run of letters (apostrophes between two letters are part of it), a run of digits, or a single mark. A dot
    before a letter or digit is a token of its own kind (INNER); line ends that only spaces part are one, and none ends a text.
    """

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = points_of("\0".join(texts) + "\0")
        first = np.cumsum(sizes + 1) - sizes - 1
        kind, upper = _looked_up(points)
        kind[first + sizes] = SPACE
        before, after = np.concatenate([[np.uint8(SPACE)], kind[:-1]]), np.concatenate([kind[1:], [np.uint8(SPACE)]])
        apostrophe = ((points == 0x27) | (points == 0x2019)) & (before == LETTER) & (after == LETTER)
        inner = (points == 0x2E) & ((after == LETTER) | (after == DIGIT) | (after == UNDERSCORE))
        kind[apostrophe] = LETTER
        kind[inner] = INNER
        before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
        run = (kind == LETTER) | (kind == DIGIT)
        begins = (kind != SPACE) & ~(run & (before == kind))
        start = np.flatnonzero(begins)
        # a run ends before the next place that isn't of it
        stops = np.flatnonzero(~run | begins)
        at = np.searchsorted(stops, start, side="right")
        end = np.where(run[start], np.concatenate([stops, [len(points)]])[at], start + 1)
        of = np.searchsorted(first, start, side="right") - 1
        token = kind[start]
        line = token == LINE
        again = line & np.concatenate([[False], line[:-1] & (of[1:] == of[:-1])])
        keep = ~again
        start, end, of, token = start[keep], end[keep], of[keep], token[keep]
        last = np.concatenate([of[1:] != of[:-1], [True]]) if len(of) else np.zeros(0, dtype=bool)
        keep = ~((token == LINE) & last)
        self.start, self.end, self.of, self.kind = start[keep], end[keep], of[keep], token[keep]
        self.n_texts, self.first = len(texts), first
        self.rolling, self.points = Rolling(points), points
        self.capital = upper[self.start]
        self.exact = self.rolling.of(self.start, self.end) if len(self.start) else np.zeros(0, dtype=np.uint64)
        self.exact[self.kind == INNER] = number("\x01 inner")
        self.spoken = (self.kind == LETTER) | (self.kind == DIGIT)

    def back(self, n: int) -> np.ndarray:
        """For every token from the n-th on, whether the one n back stands in the same text."""
        return self.of[n:] == self.of[: len(self.of) - n]

    def lasts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every text that has tokens: its number and the place of its last token."""
        at = np.flatnonzero(np.concatenate([self.of[1:] != self.of[:-1], [True]])) if len(self.of) else np.zeros(0, dtype=np.int64)
        return self.of[at], at


def portions(texts: list[str], size: int = PORTION) -> Iterator[list[str]]:
    """Texts in order, so many at a time that what is made of them fits into memory; a text is never split."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total > size:
            yield held
            held, total = [], 0
    if held:
        yield held
