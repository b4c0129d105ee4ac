"""Texts that were cut off before their end.

A text that is a strict prefix of a longer copy shows by the copy how it would go on: `prefixes` finds all of these by
hashes of fixed-length prefixes and a sort. Few cut texts have such a copy. Of the others, the end alone - the part of a
word, and the last words - is looked up as a prefix of what stands in all texts: where the last word is always longer there, it was cut
inside the word; where the texts always go on in the same line or sentence, it was cut inside that. Lengths that many
texts of one source share are its field limits; there, less evidence is enough, and an ending that most texts of one limit share
was put there by the cutting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.prefixes import longer_copies
from kinfold.llm.tokens import DIGIT, INNER, LETTER, LINE, Tokens, number, paired, portions
from kinfold.storage import Scratch

COMMON = 0.001  # words in at least this share of the texts stand for themselves in contexts; at most 1 / COMMON times the words of a text on average
LIMIT_SHARE, LIMIT_COUNT = 0.02, 5  # texts of one length that make it a limit of their source
MARK_SHARE, MARK_ELSEWHERE = 0.5, 0.1  # texts of one limit that end in a mark, if the cutting put it there; and of the source's others, for one of these
TAIL = 256
FILTER_BITS = 1 << 26  # size of the filter of the keys that are looked up: 8 MB, whatever their number

_BEGUN = re.compile(r"\d{1,4}[.)]|[*•-]|\[[ xX]?\]?")  # a line of which only the number or the bullet is there
_TRAIL = re.compile(r"[^\w\s]+$")
_TERMINAL = (".", "!", "?")

CONTEXTS = (1, 2, 3, 6)  # tokens
_WORD, _LONGER = number("word"), number("longer")
_CONTEXT, _DOT = {n: number(f"context {n}") for n in CONTEXTS}, {n: number(f"dot {n}") for n in CONTEXTS}
_CAPITAL, _SMALL, _TERMINALS = number("a capital word"), number("a small word"), np.concatenate([[number(c)] for c in _TERMINAL])
_DIGITS = np.array([number(f"{n} digits") for n in range(6)], dtype=np.uint64)
_NEWLINE, _FULL_STOP = number("\n"), number(".")
OPEN, SURE, DOTTED = 1, 2, 4


def _held(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a batch each word stands, not counting the last one of a text."""
    for batch in batches:
        for texts in portions(batch.column(0).to_pylist()):
            t = Tokens(texts)
            words = t.kind == LETTER
            words[t.lasts()[1]] = False
            key, of = t.exact[words], t.of[words]
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(key) else np.zeros(0, dtype=bool)
            word, n = np.unique(key[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


class _Forms:
    """What tokens count as: common words and marks as they are, other words and numbers by their kind; the last token of a
    context also by its kind alone if it begins with a capital."""

    def __init__(self, t: Tokens, common: np.ndarray):
        kinds = np.where(t.capital, _CAPITAL, _SMALL)
        kinds = np.where(t.kind == DIGIT, _DIGITS[np.minimum(t.end - t.start, 5)], kinds)
        self.loose = np.where(t.spoken & ~_held(common, t.exact), kinds, t.exact)
        self.last = np.where(t.capital, _CAPITAL, self.loose)
        self.before = np.concatenate([[_NEWLINE], self.loose[:-1]]) if len(self.loose) else self.loose
        if len(t.of):
            self.before[np.concatenate([[True], t.of[1:] != t.of[:-1]])] = _NEWLINE

    def contexts(self, t: Tokens) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, key, whole) for each length of context: the key of the n tokens that end with each token from the n-th on, and
        whether they are of one text."""
        context = self.last
        for n in range(1, max(CONTEXTS) + 1):
            if n > 1:
                context = paired(context[1:], self.loose[: len(self.loose) - n + 1])
            if n in CONTEXTS:
                yield n, context, t.back(n - 1)


class Filter:
    """A set of 64-bit hashes that may hold more than was put in; of fixed size."""

    def __init__(self, keys: DataFrame, column: str, bits: int = FILTER_BITS):
        word, bit = F.col(column).bitwiseAND(F.lit(bits - 1)), F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
        rows = keys.groupBy(F.shiftright(word, 6).cast("int").alias("i")).agg(F.bit_or(bit).alias("w")).toPandas()  # bits / 64 rows at most
        self.words = np.zeros(bits // 64, dtype=np.uint64)
        self.words[rows["i"].to_numpy()] = rows["w"].to_numpy(dtype=np.int64).view(np.uint64)
        self.mask = np.uint64(bits - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        return (self.words[((keys & self.mask) >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1) > 0


def statistics(common: np.ndarray, asked: Filter):
    """What follows every context, and the prefixes of every word after another, of the asked keys, added up over a batch.

    Context keys (1, 2, 3 and 6 tokens): a = times at all, b = times that a line, sentence or text ends there. Word keys
    (token before, word): a = times. Dot keys (contexts before a dot): a = times, b = times that no letter or digit follows
    the dot. Prefix keys (token before, strict prefix): a = times of longer words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (p for batch in batches for p in portions(batch.column(0).to_pylist())):
            t = Tokens(texts)
            if not len(t.start):
                continue
            forms, out = _Forms(t, common), []

            def add(keys: np.ndarray, b: np.ndarray, out: list = out) -> None:
                some = asked.may_hold(keys)
                out.append((keys[some], b[some]))

            same = np.concatenate([t.of[1:] == t.of[:-1], [False]])  # whether the next token is of the same text
            follow, follow_kind = np.concatenate([t.exact[1:], [np.uint64(0)]]), np.concatenate([t.kind[1:], [np.uint8(LINE)]])
            begins = forms.before == _NEWLINE
            listed = (t.kind == DIGIT) & begins  # the dot after a number that begins a line ends nothing
            ends = ~same | (follow_kind == LINE) | _held(np.sort(_TERMINALS), follow) & ~listed
            inner, dot = same & (follow_kind == INNER), same & (follow == _FULL_STOP) & ~listed
            for n, key, whole in forms.contexts(t):
                add(paired(key[whole], _CONTEXT[n]), ends[n - 1 :][whole])
                dots = whole & (inner | dot)[n - 1 :]
                add(paired(key[dots], _DOT[n]), dot[n - 1 :][dots])
            # words after what precedes them, the last of a text left out
            word = np.flatnonzero(t.spoken & same)
            add(paired(paired(forms.before[word], t.exact[word]), _WORD), np.zeros(len(word), dtype=bool))
            size = t.end[word] - t.start[word] - 1
            which = np.repeat(np.arange(len(word)), size)
            place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            begin = t.start[word][which]
            if len(which):
                prefix = t.rolling.of(begin, begin + place + 1)
                add(paired(paired(forms.before[word][which], prefix), _LONGER), np.zeros(len(which), dtype=bool))
            keys, b = (np.concatenate(x) for x in zip(*out))
            inverse, distinct = pd.factorize(keys)
            a = np.bincount(inverse, minlength=len(distinct))
            b = np.bincount(inverse, weights=b, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["key", "a", "b"])

    return run


def _short_row(text: str) -> bool:
    """Whether all lines but the last have the same number of separators, two or more, and the last has fewer."""
    head = text.lstrip().split("\n", 1)[0]
    seps = [s for s in (",", ";", "\t", "|") if head.count(s) >= 2]
    if not seps:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) >= 4 and any(len({x.count(s) for x in lines[:-1]}) == 1 and lines[-1].count(s) < head.count(s) for s in seps)


def last_tokens(texts: list[str], least: int = 8) -> Tokens:
    """The last tokens of every text, `least` at least if it has so many; the same as those of the whole text."""
    parts = [x[-TAIL:] for x in texts]
    while True:
        # the first token of a part may have been cut: the part goes on behind it
        t = Tokens(parts)
        n = np.bincount(t.of, minlength=len(parts))
        short = [i for i in np.flatnonzero(n <= least + 1).tolist() if len(parts[i]) < len(texts[i])]
        if not short:
            break
        for i in short:
            parts[i] = texts[i][-4 * len(parts[i]) :]
    first = np.searchsorted(t.of, np.arange(len(parts)))
    cut = [p[int(t.end[f] - t.first[i]) :] if len(p) < len(x) and n[i] else p for i, (p, x, f) in enumerate(zip(parts, texts, first.tolist()))]
    return Tokens(cut)


def _state(text: str) -> tuple[int, str, str]:
    """(state, mark, end): how a text ends by itself, its last run of marks, and the text without spaces at its end."""
    end = text.rstrip()
    if not end:
        return 0, "", ""
    if end[-1] == "�" and len(end) > 1:
        return SURE, "", ""
    found = _TRAIL.search(end[-TAIL:])
    mark = found.group() if found else ""
    line = end.rsplit("\n", 1)[-1].lstrip()
    if end[-1] in _TERMINAL:
        if _BEGUN.fullmatch(line):
            return SURE, mark, ""
        # a dot right behind a letter or digit may be one inside a name, a number or an abbreviation
        if text[-1] == "." and len(text) > 1 and text[-2].isalnum():
            return DOTTED, mark, text[:-1]
        return 0, mark, ""
    sure = _BEGUN.fullmatch(line) or line[0] == "{" and line[-1] != "}" or _short_row(end) or end[-1] == "-" and end[-2:-1].isalpha()
    return OPEN | (SURE if sure else 0), mark, end


def endings(common: np.ndarray):
    """How each text (h, text) ends: state, and the keys to look up, 0 for none: word, longer, contexts, dots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            states = [_state(x) for x in texts]
            state = np.array([s for s, _, _ in states], dtype=np.int32)
            t = last_tokens([e for _, _, e in states])
            forms = _Forms(t, common)
            keys = np.zeros((len(texts), 2 + 2 * len(CONTEXTS)), dtype=np.uint64)
            of, at = t.lasts()
            spoken = np.array([x[-1:].isalnum() for x in texts], dtype=bool)
            opened = (state[of] & OPEN) > 0
            word = opened & t.spoken[at] & spoken[of]
            w = paired(forms.before[at], t.exact[at])
            keys[of[word], 0], keys[of[word], 1] = paired(w, _WORD)[word], paired(w, _LONGER)[word]
            dotted = (state[of] & DOTTED) > 0
            for k, (n, key, whole) in enumerate(forms.contexts(t)):
                i = at - n + 1
                there = i >= 0
                there[there] = whole[i[there]]
                for which, column, salt in ((opened, 2 + k, _CONTEXT[n]), (dotted, 2 + len(CONTEXTS) + k, _DOT[n])):
                    some = there & which
                    keys[of[some], column] = paired(key[i[some]], salt)
            state[np.bincount(t.of, minlength=len(texts)) == 0] &= SURE
            asked = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(state), pa.array([m for _, m, _ in states], pa.string()), asked], names=["h", "state", "mark", "keys"])

    return run


def _goes_on(behind: F.Column, text_end: F.Column) -> F.Column:
    """Why a text with this end, in a longer copy followed by `behind`, was cut: 'word', 'sentence' or null."""
    alnum = r"^[\p{L}\p{N}_]"
    in_word = text_end.rlike(r"[\p{L}\p{N}_.]$") & behind.rlike(alnum) & ~text_end.rlike(r"\s\.$")
    # a copy that has only a full stop more shows a text that is whole
    in_line = ~text_end.rlike(r"[.!?]['\"”’)]*\s*$|\n\s*$") & ~behind.rlike(r"^[.!?]*[ \t]*(\r?\n|$)")
    return F.when(in_word, "word").when(in_line, "sentence")


def truncated(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, source, at_limit, reason, way) of the texts that were cut inside a word, line or sentence, or end in a cutting mark.

    documents: (id bigint, source, text). Null and empty texts, and texts that end a sentence, aren't cut; a last dot is
    looked up too, as it may be one inside a name or number. Repeated ids are judged each by itself, exact copies of a text
    alike in a source, however many there are. A null source is a source of its own. way tells what the finding comes from:
    'copy' (a longer copy of the text), 'mark' (what the cutting of a limit adds), 'ends' (how texts with such an end go on),
    'form' (the form alone: a broken character, row, list entry or bracket).
    """
    rows = documents.where("id is not null and text is not null and trim(text) <> ''").select(F.col("id").cast("long").alias("id"), "source", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("h"), "text")
    # exact copies of a text tell nothing more about its end: statistics and limits take one of them
    texts, seen = scratch.measured(rows.groupBy("h").agg(F.first("text").alias("text")), "texts", n=F.count(F.lit(1)))
    held = scratch.cut(rows.select("id", "source", "h", F.length("text").alias("chars"), F.octet_length("text").alias("bytes")), "rows")
    words = texts.select("text").mapInArrow(word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = words.where(F.col("n") >= max(3, COMMON * seen["n"])).select("word").toPandas()["word"].to_numpy(dtype=np.int64).view(np.uint64)
    common = np.sort(common)

    ends = scratch.cut(texts.mapInArrow(endings(common), "h binary, state int, mark string, keys array<long>"), "ends")
    each = ends.where(F.exists("keys", lambda k: k != 0)).select("h", F.posexplode("keys").alias("k", "key")).where("key <> 0")
    asked = scratch.cut(each.select("key").distinct(), "asked")
    counts = texts.select("text").mapInArrow(statistics(common, Filter(asked, "key")), "key long, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known = counts.join(asked, "key", "left_semi")
    told = each.join(known, "key").groupBy("h").pivot("k", list(range(2 + 2 * len(CONTEXTS)))).agg(F.max("a").alias("a"), F.max("b").alias("b"))

    sizes = scratch.cut(held.select("source", "h", "chars", "bytes").distinct(), "sizes")
    of_source = Window.partitionBy("source")
    both = sizes.select("source", "h", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("s"))
    both = both.select("source", "h", "s.unit", "s.size")
    n = both.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(of_source) / 2)
    limits = n.where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_SHARE * F.col("all"))).select(F.col("source").alias("l_source"), F.col("unit").alias("l_unit"), F.col("size").alias("l_size"), F.col("n").alias("l_n"), F.col("all").alias("l_all"))
    limits = scratch.cut(limits, "limits")
    at = (both["source"].eqNullSafe(limits["l_source"])) & (both["unit"] == limits["l_unit"]) & (both["size"] == limits["l_size"])
    limited = scratch.cut(both.join(limits, at).select("source", "h", "unit", "size", "l_n", "l_all"), "limited")
    by_mark = ends.where("mark <> ''").select("h", "mark")
    everywhere = sizes.join(by_mark, "h").groupBy(F.col("source").alias("e_source"), F.col("mark").alias("e_mark")).agg(F.count(F.lit(1)).alias("e_n"))
    marks = limited.join(by_mark, "h").groupBy("source", "unit", "size", "mark").agg(F.count(F.lit(1)).alias("m"), F.max("l_n").alias("l_n"), F.max("l_all").alias("l_all"))
    marks = marks.where(F.col("m") >= MARK_SHARE * F.col("l_n")).join(everywhere, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("mark") == F.col("e_mark")))
    other = (F.col("e_n") - F.col("m")) / F.greatest(F.col("l_all") - F.col("l_n"), F.lit(1.0))
    marks = marks.where(other <= MARK_ELSEWHERE * F.col("m") / F.col("l_n")).select(F.col("source").alias("m_source"), F.col("unit").alias("m_unit"), F.col("size").alias("m_size"), F.col("mark").alias("m_mark"))
    same = limited["source"].eqNullSafe(marks["m_source"]) & (limited["unit"] == marks["m_unit"]) & (limited["size"] == marks["m_size"])
    has = limited.join(marks, same, "left").groupBy("source", "h").agg(F.collect_set("m_mark").alias("marks"))  # of a text's one or two limits
    has = has.select(F.col("source").alias("at_source"), F.col("h").alias("at_h"), "marks")

    copies = longer_copies(texts, scratch).join(texts.select("h", F.substr("text", F.greatest(F.length("text") - 15, F.lit(1))).alias("last")), "h")
    copies = copies.select("h", _goes_on(F.col("behind"), F.col("last")).alias("by_copy")).where("by_copy is not null")
    judged = ends.select("h", "state", "mark").join(told, "h", "left").join(copies, "h", "left").withColumnRenamed("h", "j_h")
    judged = held.select("id", "source", "h").join(judged, F.col("h") == F.col("j_h"))
    judged = judged.join(has, (F.col("h") == F.col("at_h")) & F.col("source").eqNullSafe(F.col("at_source")), "left").withColumn("at_limit", F.col("at_h").isNotNull())

    def n_(k: int, what: str) -> F.Column:
        return F.coalesce(F.col(f"{k}_{what}"), F.lit(0))

    # the text's own end is among the counted ones
    open_, sure, dotted = (F.col("state").bitwiseAND(b) > 0 for b in (OPEN, SURE, DOTTED))
    in_word = open_ & (n_(1, "a") > 0) & (n_(1, "a") >= 20 * n_(0, "a"))

    def runs_on(first: int) -> F.Column:
        share = None
        for k, least in ((3, 8), (2, 8), (1, 8), (0, 1)):
            s = F.when(n_(first + k, "a") - 1 >= least, (n_(first + k, "b") - 1) / (n_(first + k, "a") - 1))
            share = s if share is None else F.coalesce(share, s)
        return F.when(F.col("at_limit"), share < 0.5).otherwise(share < 0.03)

    marked = F.col("at_limit") & F.exists("marks", lambda m: F.col("mark").endswith(m))
    by_ends = F.when(in_word | dotted & runs_on(2 + len(CONTEXTS)), "word").when(open_ & runs_on(2), "sentence")
    reason = F.coalesce(F.col("by_copy"), F.when(marked, "mark"), F.when(sure, "line"), by_ends)
    way = F.when(F.col("by_copy").isNotNull(), "copy").when(marked, "mark").when(sure, "form").otherwise("ends")
    return judged.withColumn("reason", reason).withColumn("way", way).where("reason is not null").select("id", "source", "at_limit", "reason", "way")
