"""Passages of held-out items inside documents.

Documents and items become sequences of words free of case, markup, punctuation and the usual letter confusions;
a word one letter away from items' words counts as any of them. Windows of both get SimHash fingerprints, weighted by
how rare a word is in the documents. Two fingerprints within the radius agree in at least BLOCKS - RADIUS of their blocks,
so looking up every choice of that many blocks finds all such pairs. Candidates are verified exactly: by the weighted
share of the item's word shingles in a stretch of the document, then by aligning the words.

Documents are read and coded once for all items; items are then searched for in passes of bounded size over the codes.
Only windows that a stretch can be in are fingerprinted: of the 9 neighbouring word pairs of some window inside any stretch
that `aligned_span` accepts, at least PAIRS stand side by side in the item as well, and of some 23 neighbouring pairs STRETCH_PAIRS. Proof: an edit makes at most two pairs
differ. Where edits are APART = 4 matching words apart, each second edit is five words on, so 9 pairs hold at most two edits
and at least 5 pairs stay. Otherwise a stretch of n words has at most 0.15 n edits (4 points each, of 0.6 n at most) and (n - 16) / 4, and
of its disjoint runs of 9 pairs the one with the fewest edits has at least 6 left. In the same way, 20 words with at most 4 edits keep
11 of their 19 pairs, and 23 pairs of a longer stretch with at most 12 edits' worth of differing ones keep 11.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.storage import Scratch

STRETCH = 20  # successive words of an item that make a leak
WINDOW = 10  # words of a fingerprint: a stretch with an edit here and there still holds nearly whole windows
PAIRS = 5  # neighbouring words of a window that stand side by side in an item
STRETCH_PAIRS = 11  # the same of STRETCH + 3 neighbouring pairs
RADIUS, BLOCKS, BITS = 8, 11, 64
SHINGLES = 0.35  # share of the weight of an item's shingles that a stretch must hold
APART = 4  # matching words between two edits of a stretch
SHARED_OPENING = 3  # items that begin with the same sentence make it an instruction
WORDS_A_PASS, WORDS_A_CODING = 50_000, 5_000_000  # words of items searched for together, and coded together
WORDS_AT_ONCE = 200_000  # words of documents

_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-zA-Z#0-9]{1,8};|-[ \t]*\r?\n[ \t>]*(?=[a-z])")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"[\dol]+")  # as words() leaves them
_OTHER, _OTHER_NUMBER = -1, -2  # codes of words and numbers that no item has
_CONFUSED = str.maketrans({"0": "o", "1": "l"})


def words(text: str | None) -> list[str]:
    """Words in a form that differences of case, markup, punctuation, spacing and marks on letters don't change."""
    if not text:
        return []
    if "<" in text or "&" in text or "-" in text:
        text = _MARKUP.sub(lambda m: "" if m.group().startswith("-") else " ", text)
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.translate(_CONFUSED))


def _cut_one(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


def one_apart(a: str, b: str) -> bool:
    """Whether one letter changed, dropped or added, or two neighbours swapped, makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        at = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
        return len(at) == 1 or (len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]])
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return any(short == x for x in _cut_one(long))


class Vocabulary:
    """The items' words by number; other words are looked up by one letter's difference, from two letters on."""

    def __init__(self, known: list[str]):
        self.known = known
        self.number = {w: i for i, w in enumerate(known)}
        self.cut: dict[str, list[int]] = {}
        for i, w in enumerate(known):
            if len(w) >= 2:
                for c in {w, *_cut_one(w)}:
                    self.cut.setdefault(c, []).append(i)
        self.seen: dict[str, tuple[int, tuple[int, ...]]] = {w: (i, ()) for w, i in self.number.items()}

    def near(self, word: str) -> tuple[int, ...]:
        """The items' words one letter away."""
        if not 2 <= len(word) <= 40:
            return ()
        near = {i for c in (word, *_cut_one(word)) for i in self.cut.get(c, ())}
        # of words below three letters, only swapped ones
        return tuple(i for i in sorted(near) if one_apart(word, self.known[i]) and (len(word) > 2 or sorted(word) == sorted(self.known[i])))

    def look(self, word: str) -> tuple[int, tuple[int, ...]]:
        """The number of a word, and of one that no item has: that of the first word a letter away, and those of all such words."""
        found = self.seen.get(word)
        if found is None:
            near = self.near(word)
            found = (near[0] if near else _OTHER_NUMBER if _NUMBER.fullmatch(word) else _OTHER, near)
            if len(self.seen) > 2_000_000:
                self.seen = {w: (i, ()) for w, i in self.number.items()}
            self.seen[word] = found
        return found

    def find(self, word: str) -> int:
        return self.look(word)[0]


def _coded(known: list[str]):
    """Documents as numbers of the items' words, below 0 for others; those without WINDOW known words hold no stretch.

    near: (place, number) of all the items' words that a word which no item has may stand for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(known)
        for batch in batches:
            ids, codes, near = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen, look = vocabulary.seen.get, vocabulary.look
                looked = [seen(w) or look(w) for w in words(text)]
                found = np.fromiter((x[0] for x in looked), dtype=np.int32, count=len(looked))
                if np.count_nonzero(found >= 0) >= WINDOW:
                    ids.append(i)
                    codes.append(found.tobytes())
                    near.append(np.array([(k, n) for k, x in enumerate(looked) if x[1] for n in x[1]], dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), pa.array(near, pa.binary())], names=["id", "codes", "near"])

    return run


def _frequencies(n: int):
    """How many documents hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n + 1, dtype=np.int64)
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                df[np.unique(np.maximum(np.frombuffer(codes, dtype=np.int32), -1)) + 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(df[1:], pa.int64())], names=["word", "df"])

    return run


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Sums of all windows of the width (of the whole, if it is shorter), along axis 0."""
    width = min(width, len(values))
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[width:] - total[:-width]


class Index:
    """Fingerprints of all windows of the items, by every choice of blocks that two within the radius agree in."""

    def __init__(self, items: list[tuple[int, np.ndarray]], known: list[str], weight: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS, seed: int = 7):
        self.items, self.weight, self.radius = items, np.append(weight, [0.0, 0.0]), radius
        self.number = np.array([bool(_NUMBER.fullmatch(w)) for w in known] + [True, False])
        # the planes follow from the words alone, so every pass and every executor has the same
        planes = np.array([np.random.default_rng([seed, *w.encode()]).integers(0, 2, BITS) * 2.0 - 1 for w in known])
        self.planes = np.concatenate([planes, np.zeros((2, BITS))]) * self.weight[:, None]
        prints = [self.fingerprints(codes) for _, codes in items]
        self.prints, self.owner = np.concatenate(prints), np.repeat(np.arange(len(items), dtype=np.int32), [len(p) for p in prints])
        limits = np.linspace(0, BITS, blocks + 1).astype(int).tolist()
        self.choices = []
        for chosen in combinations(zip(limits, limits[1:]), blocks - radius):
            key = self._key(self.prints, chosen)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.choices.append((chosen, key[order], order))
        self.n_words = len(known)
        self.shingles = []
        for _, codes in items:
            pairs = codes[:-1].astype(np.int64) * self.n_words + codes[1:]
            mass = self.weight[codes[:-1]] + self.weight[codes[1:]]
            self.shingles.append((set(pairs.tolist()), float(_rolled(mass, STRETCH - 1).min())))
        vocabulary = Vocabulary(known)
        # a word of one item may be another item's word misspelt
        self.beside = [vocabulary.near(w) for w in known]
        self.members = [set(c.tolist()) for _, c in items]
        self.own = np.zeros(self.n_words + 2, dtype=bool)
        self.own[np.concatenate([c for _, c in items])] = True
        self._others = np.array([c for b in self.beside for c in b], dtype=np.int64)
        self._first = np.concatenate([[0], np.cumsum([len(b) for b in self.beside])])
        owned = sorted((p, n) for n, (pairs, _) in enumerate(self.shingles) for p in pairs)
        self.pairs, self.pair_owner = np.array([p for p, _ in owned]), np.array([n for _, n in owned])
        self.windows = self.compared = 0  # looked up so far, and fingerprints that they were compared with

    @staticmethod
    def _key(prints: np.ndarray, chosen: tuple[tuple[int, int], ...]) -> np.ndarray:
        key = np.zeros(len(prints), dtype=np.uint64)
        for lo, hi in chosen:
            key = key << np.uint64(hi - lo) | (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        return key.astype(np.uint32)

    def fingerprints(self, codes: np.ndarray, at: np.ndarray | None = None, planes: np.ndarray | None = None) -> np.ndarray:
        """Of the windows that begin at the given places, or of all."""
        planes = self.planes if planes is None else planes
        at = np.arange(len(codes) - WINDOW + 1) if at is None else at
        out = np.zeros(len(at), dtype=np.uint64)
        for lo in range(0, len(at), 16_384):
            own = at[lo : lo + 16_384]
            total = np.zeros((len(own), BITS))
            for k in range(WINDOW):
                total += planes[codes[own + k]]
            out[lo : lo + 16_384] = np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): all fingerprints j of the index within the radius of prints[i]; a pair may be given more than once."""
        which, other = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        self.windows += len(prints)
        for chosen, keys, order in self.choices:
            key = self._key(prints, chosen)
            first = np.searchsorted(keys, key)
            n = np.searchsorted(keys, key, side="right") - first
            row = np.repeat(np.arange(len(prints)), n)
            j = order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]]
            self.compared += len(j)
            close = np.flatnonzero(np.bitwise_count(self.prints[j] ^ prints[row]) <= self.radius)
            which.append(row[close])
            other.append(j[close])
        return np.concatenate(which), np.concatenate(other)

    def options(self, codes: np.ndarray, near: np.ndarray | None = None) -> list[tuple[tuple[int, bool], ...]]:
        """The items' words that each word of a document may stand for (near: as of `_coded`), False for those that a
        word of another item may stand for."""
        out = [((c, True), *((b, False) for b in self.beside[c])) if c >= 0 else () for c in codes.tolist()]
        misspelt: dict[int, list[int]] = {}
        for k, n in (() if near is None else near.reshape(-1, 2).tolist()):
            misspelt.setdefault(k, []).append(n)
        for k, ns in misspelt.items():
            out[k] = tuple((n, True) for n in ns)
        return out

    def _readings(self, codes: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, code, read): what the words of the codes may stand for, read where it isn't what the fingerprints take.

        Only words of the items of this index, and only where WINDOW words have enough of them for PAIRS pairs.
        """
        exact = codes >= 0
        exact[at] = False
        exact = np.flatnonzero(exact)
        first, n = self._first[codes[exact]], np.diff(self._first)[codes[exact]]
        more = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        place = np.concatenate([exact, at, np.repeat(exact, n)])
        code = np.concatenate([codes[exact], which, self._others[more]])
        read = np.concatenate([np.zeros(len(exact), bool), which != codes[at], np.ones(len(more), bool)])
        own = self.own[code]
        place, code, read = place[own], code[own], read[own]
        spoken = np.zeros(len(codes) + 1, dtype=np.int64)
        spoken[place] = 1
        many = np.flatnonzero(_rolled(spoken[:-1], WINDOW) > PAIRS) if len(codes) >= WINDOW else np.zeros(0, dtype=np.int64)
        open_ = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(open_, many, 1)
        np.add.at(open_, many + WINDOW, -1)
        some = np.cumsum(open_)[place] > 0
        place, code, read = place[some], code[some], read[some]
        order = np.argsort(place, kind="stable")
        return place[order], code[order], read[order]

    def find(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, list[int]]]:
        """(document, item, places): where a document (codes, near) may hold a stretch of an item.

        It does where a window has a fingerprint within the radius of one of the item's; and where three of the item's word
        pairs lie close together if misspelt words are read otherwise than the fingerprints do. Documents without
        STRETCH_PAIRS pairs of the item in a stretch's length are left out.
        """
        sizes = np.array([len(c) for c, _ in docs], dtype=np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        codes = np.concatenate([x for c, _ in docs for x in (c, [np.int32(_OTHER)])]).astype(np.int64)
        misspelt = [n.reshape(-1, 2) + [b, 0] for (_, n), b in zip(docs, begin.tolist()) if len(n)]
        at, which = np.concatenate(misspelt).T if misspelt else np.zeros((2, 0), dtype=np.int64)
        place, code, read = self._readings(codes, at, which)
        lo, hi = np.searchsorted(place, place + 1), np.searchsorted(place, place + 2)
        a = np.repeat(np.arange(len(place)), hi - lo)
        b = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        key = code[a] * self.n_words + code[b]
        first, n = np.searchsorted(self.pairs, key), np.searchsorted(self.pairs, key, side="right")
        held = np.flatnonzero(n > first)
        good = np.zeros(len(codes), dtype=np.int64)
        good[place[a[held]]] = 1
        # pairs across documents aren't pairs: a separator is no word
        windows = np.flatnonzero(_rolled(good, WINDOW - 1) >= PAIRS) if len(codes) >= WINDOW else np.zeros(0, dtype=np.int64)
        doc = np.searchsorted(begin, windows, side="right") - 1
        inside = windows + WINDOW <= begin[doc] + sizes[doc]
        windows, doc = windows[inside], doc[inside]
        if not len(windows):
            return []
        # what is sought below is numbered item by item, place by place
        span = len(codes) + STRETCH

        def document(x: np.ndarray) -> np.ndarray:
            return np.searchsorted(begin, x % span, side="right") - 1

        def in_one(x: np.ndarray, k: int, reach: int) -> np.ndarray:
            """Where k of sorted numbers lie within the reach, of one item and document."""
            return np.flatnonzero((x[k - 1 :] - x[: len(x) - k + 1] < reach) & (document(x[k - 1 :]) == document(x[: len(x) - k + 1]))) if len(x) >= k else np.zeros(0, dtype=np.int64)

        open_ = np.zeros(len(codes) + WINDOW, dtype=np.int64)
        np.add.at(open_, windows, 1)
        np.add.at(open_, windows + WINDOW - 1, -1)
        held = held[np.cumsum(open_)[place[a[held]]] > 0]
        m = n[held] - first[held]
        owner = self.pair_owner[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[held], m)].astype(np.int64)
        pairs = owner * span + np.repeat(place[a[held]], m)
        # the proof holds for the pairs of one item: without STRETCH_PAIRS of its own close together, no stretch of it is there
        every = np.unique(pairs)
        many = every[in_one(every, STRETCH_PAIRS, STRETCH + 3)]
        able = np.unique(many // span * len(docs) + document(many))
        other = np.unique(pairs[np.repeat((read[a] | read[b])[held], m)])
        three = in_one(other, 3, STRETCH)
        codes_, planes = codes, self.planes
        if len(at):  # the mean of all that a misspelt word may stand for
            own, where = np.unique(at, return_inverse=True)
            mean = np.zeros((len(own), BITS))
            np.add.at(mean, where, self.planes[which])
            codes_, planes = codes.copy(), np.concatenate([self.planes, mean / np.bincount(where)[:, None]])
            codes_[own] = len(self.planes) + np.arange(len(own))
            codes_[codes_ < 0] += len(self.planes)
        i, j = self.within(self.fingerprints(codes_, windows, planes))
        close = np.unique(np.concatenate([*(other[three + k] for k in range(3)), self.owner[j].astype(np.int64) * span + windows[i]]))
        group = close // span * len(docs) + document(close)
        some = np.isin(group, able)
        close, group = close[some], group[some]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() if len(group) else []
        found = [(int(group[s] % len(docs)), int(group[s] // len(docs)), close[s:e] % span) for s, e in zip(starts, [*starts[1:], len(group)])]
        return [(d, k, (x - begin[d]).tolist()) for d, k, x in sorted(found, key=lambda f: f[:2])]

    def verify(self, codes: np.ndarray, n: int, at: list[int], stretch: int = STRETCH, options: list[tuple[tuple[int, bool], ...]] | None = None) -> bool:
        """Whether the document holds a stretch of item n about one of the places."""
        item = self.items[n][1]
        known, mass = self.shingles[n]
        members = self.members[n]
        options = self.options(codes) if options is None else options
        reach = len(item) + STRETCH
        lo = 0
        while lo < len(at):  # places that are close share a region
            hi = lo
            while hi + 1 < len(at) and at[hi + 1] - at[hi] <= reach:
                hi += 1
            region = slice(max(0, at[lo] - reach), at[hi] + WINDOW + reach)
            part = codes[region]
            lo = hi + 1
            if len(part) < 2:
                continue
            own = [tuple(c for c in o if c[0] in members) for o in options[region]]
            weight = np.zeros(len(part) - 1)
            for k, (a, b) in enumerate(zip(own, own[1:])):
                if a and b:
                    weight[k] = max((self.weight[c] + self.weight[d] for c, _ in a for d, _ in b if c * self.n_words + d in known), default=0.0)
            if _rolled(weight, STRETCH + 3).max() >= SHINGLES * mass and aligned_span(part, item, self.number, own, enough=stretch) >= stretch:
                return True
        return False


def aligned_span(part: np.ndarray, item: np.ndarray, number: np.ndarray | None = None, options: list[tuple[tuple[int, bool], ...]] | None = None, edit: int = 4, quality: float = 0.4, least: int = STRETCH - 4, apart: int = APART, enough: int | None = None) -> int:
    """Words of the item in the longest stretch that the part holds in order, 0 if there is none of STRETCH words.

    A stretch is a chain of matching cells that goes on over single words changed, dropped or added, at its start as at
    its end. It counts if it has `least` words and `quality` of its words left when `edit` are taken off for each edit,
    which STRETCH words with one edit have, or if its edits are `apart` matching words apart and none is of a number
    (number: whether a code is one): texts of the same pattern with other names and numbers stay below that.
    options: for each word of the part, all that it may stand for; what is False there must have no edit beside it.
    enough: with a stretch of so many words no longer one is looked for.
    """
    places: dict[int, list[int]] = {}
    for j, c in enumerate(item.tolist()):
        places.setdefault(c, []).append(j)
    digits = (lambda c: False) if number is None else (lambda c: bool(number[c]))
    moves = ((2, 2), (2, 1), (1, 2))  # words of the part and of the item back
    # the least origins of the chains that end in a cell: by their edits, and by the matches since the last edit
    rows: list[dict[int, tuple[dict[int, int], dict[int, int], bool]]] = [{}, {}]
    none: tuple[dict[int, int], dict[int, int], bool] = ({}, {}, False)
    best, before = 0, -1
    for i, c in enumerate(part.tolist()):
        new = {}
        for j, firm in [(j, firm) for o, firm in (((c, True),) if options is None else options[i]) for j in places.get(o, ())]:
            chains, runs = {0: j}, {apart: j}
            last = rows[-1].get(j - 1, none)
            for k, origin in last[0].items():
                chains[k] = min(origin, chains.get(k, j))
            for run, origin in last[1].items():
                run = min(run + 1, apart)
                runs[run] = min(origin, runs.get(run, j))
            for back, left in moves if firm else ():
                last = rows[-back].get(j - left, none)
                if not last[2]:
                    continue
                for k, origin in last[0].items():
                    chains[k + 1] = min(origin, chains.get(k + 1, j))
                if apart in last[1] and not (back == 2 and digits(before) or left == 2 and digits(item[j - 1])):
                    runs[1] = min(last[1][apart], runs.get(1, j))
            # more edits are worth keeping for an earlier origin only
            kept, first = {}, j + 1
            for k in sorted(chains):
                if chains[k] < first and edit * k <= len(item):
                    kept[k] = first = chains[k]
            new[j] = (kept, runs, firm)
            for k, origin in kept.items():
                span = j - origin + 1
                if span > best and span - edit * k >= max(least, quality * span):
                    best = span
            best = max(best, j - min(runs.values()) + 1)
        if enough is not None and best >= enough:
            break
        rows, before = [rows[1], new], c
    return best if best >= STRETCH else 0


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[tuple]) -> pa.RecordBatch:
            docs, items, options = [], [], {}
            for d, n, at in index.find([(c, m) for _, c, m in held]):
                i, codes, near = held[d]
                if d not in options:
                    options = {d: index.options(codes, near)}
                if index.verify(codes, n, at, options=options[d]):
                    docs.append(i)
                    items.append(index.items[n][0])
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

        held, total = [], 0
        for batch in batches:
            for i, raw, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append((i, np.frombuffer(raw, dtype=np.int32), np.frombuffer(near, dtype=np.int32)))
                total += len(raw) // 4
                if total >= WORDS_AT_ONCE:
                    yield found(held)
                    held, total = [], 0
        if held:
            yield found(held)

    return run


def item_bodies(items: DataFrame) -> DataFrame:
    """(id, body): texts without an instruction that they begin with.

    An instruction is a first sentence that goes on in at least SHARED_OPENING ways: one that items share together with
    what follows is a passage, and stays.
    """
    sentences = r"^\s*([^.!?]*[.!?])\s+([^.!?]*[.!?]?)"
    cut = items.where("id is not null and text is not null").select("id", "text", F.regexp_extract("text", sentences, 1).alias("opening"), F.regexp_extract("text", sentences, 2).alias("second"))
    shared = cut.where("opening <> ''").groupBy("opening").agg(F.countDistinct("second").alias("n")).where(F.col("n") >= SHARED_OPENING)
    joined = cut.join(shared, "opening", "left")
    return joined.select("id", F.when(F.col("n").isNotNull(), F.expr("substr(text, instr(text, opening) + length(opening))")).otherwise(F.col("text")).alias("body"))


def leaks(documents: DataFrame, items: DataFrame, scratch: Scratch, words_a_pass: int = WORDS_A_PASS, words_a_coding: int = WORDS_A_CODING) -> DataFrame:
    """(doc_id, item_id) of the documents (id bigint, text) that hold at least STRETCH successive words of an item.

    Items (id bigint, text) are coded together, with all documents, in groups of bounded size (one, up to five million
    words), and searched for in passes of bounded size. Items of fewer words hold no stretch, null and empty texts no words; null
    ids are left out. Repeated pairs are given once.
    """
    spark = documents.sparkSession
    bodies, seen = scratch.measured(item_bodies(items), "items", n=F.sum(F.size(F.split("body", r"\s+"))))
    groups, out = max(1, -(-(seen["n"] or 0) // words_a_coding)), None
    for g in range(groups):
        own = bodies.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).orderBy("id").collect()
        texts = [(r["id"], w) for r in own if len(w := words(r["body"])) >= STRETCH]
        if not texts:
            continue
        known = sorted({w for _, ws in texts for w in ws})
        number = {w: i for i, w in enumerate(known)}
        coded = [(i, np.array([number[w] for w in ws], dtype=np.int32)) for i, ws in texts]
        docs = documents.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
        docs, seen = scratch.measured(docs.mapInArrow(_coded(known), "id long, codes binary, near binary"), "coded", n=F.count(F.lit(1)))
        df = dict(docs.select("codes").mapInArrow(_frequencies(len(known)), "word int, df long").groupBy("word").agg(F.sum("df")).collect())
        weight = np.log((1 + seen["n"]) / (1 + np.array([df.get(i, 0) for i in range(len(known))], dtype=float))) + 0.1
        while coded:
            k, total = 0, 0
            while k < len(coded) and (not k or total + len(coded[k][1]) <= words_a_pass):
                total += len(coded[k][1])
                k += 1
            found = docs.mapInArrow(_search(Index(coded[:k], known, weight)), "doc_id long, item_id long")
            out, coded = found if out is None else out.unionByName(found), coded[k:]
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()
