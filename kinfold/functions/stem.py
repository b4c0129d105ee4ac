"""English stems by the published Porter2 rules, in Arrow batches over distinct words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words without content
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few
    for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
    other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up
    very was we were what when where which while who whom why will with you your yours yourself yourselves""".split()
)
# fixed values: words with stems of their own
_WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes", "inning": "inning", "outing": "outing", "canning": "canning", "herring": "herring", "earring": "earring",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# fixed values: endings of the second and third step and what takes their place, longest first where one holds another
_SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    """Where the parts after the first and the second vowel-consonant begin."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if start is None:
        m = _REGION.search(w)
        start = m.end() if m else len(w)
    m = _REGION.search(w, start)
    return start, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and those with other signs, are their own."""
    w = word.replace("’", "'").lstrip("'")
    if len(w) <= 2 or not re.fullmatch(r"[a-z']+", w):
        return word
    if w in _WHOLE:
        return _WHOLE[w]
    # y is a consonant at the start and after vowels
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    # past and progressive
    if w.endswith(("eedly", "eed")):
        n = 5 if w.endswith("eedly") else 3
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and _VOWEL.search(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # endings within the first region
    for table in (_SECOND, _THIRD):
        end = next((e for e in sorted((*table, *(("ogi", "li") if table is _SECOND else ("ative",))), key=len, reverse=True) if w.endswith(e)), None)
        if end and len(w) - len(end) >= r1:
            if end == "ogi":
                w = w[:-1] if w.endswith("logi") else w
            elif end == "li":
                w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
            elif end == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            else:
                w = w[: -len(end)] + table[end]
    # endings within the second region
    end = next((e for e in sorted((*_FOURTH, "ion"), key=len, reverse=True) if w.endswith(e)), None)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """Stems of words; null stays null."""
    return words.map(stem, na_action="ignore")
