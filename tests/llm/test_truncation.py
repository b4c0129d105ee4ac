import random
import re

from kinfold.llm import truncation
from kinfold.llm.prefixes import LEAST, longer_copies
from kinfold.llm.tokens import INNER, Tokens, text_hash

SENTENCES = [
    "The committee moved the {} folder to the old drive before {}.", "Nobody objected when {} renamed the {} report twice.", "Please do not delete the {} until {} has read it.",
    "We counted 12 files in the {} archive, and 3 of them had no owner named {}.",
]
NOUNS = ["garden", "harbour", "kitchen", "library", "minutes", "invoice", "roster", "survey"]


def text(rng, n):
    return " ".join(rng.choice(SENTENCES).format(rng.choice(NOUNS), rng.choice(NOUNS)) for _ in range(n))


def found(spark, scratch, docs):
    df = spark.createDataFrame([(*d, True, 1) for d in docs], "id long, source string, text string, at_limit boolean, state int")
    return {r["id"]: r["reason"] for r in truncation.truncated(df, scratch).collect()}


def test_cuts_and_decoys(spark, scratch):
    rng = random.Random(8)
    docs = [(i, "mail", text(rng, 4)) for i in range(300)]
    docs += [(1000 + i, "form", text(rng, 9)[:200]) for i in range(60)] + [(2000 + i, "form", text(rng, 2)) for i in range(200)]
    docs += [(3000 + i, "clip", text(rng, 9)[:100] + "...") for i in range(40)] + [(4000 + i, "clip", text(rng, 1)) for i in range(100)]
    whole = text(rng, 2)
    docs += [
        (1, "mail", whole + " Nobody objected when the lib"), (2, "mail", whole + " Please do not delete the"), (3, "mail", whole[:-1]), (4, "mail", "note,who,n\na,b,1\nc,d,2\ne,f"), (5, "mail", '{"a": "the committee'), (6, "mail", whole + " Nob�"),
        (7, "mail", whole + "\n\n2."), (8, "mail", None), (9, "mail", ""), (10, "mail", " \n "), (11, None, whole), (12, "mail", "and so on..."), (13, "mail", whole + "\n\n"),
    ]
    docs = [d for d in docs if not (d[0] < 14 and d[0] in range(14))] + [d for d in docs if d[0] in range(14) and d in docs[-13:]]
    got = found(spark, scratch, docs)
    assert {i: got.get(i) for i in range(1, 14)} == {1: "word", 2: "sentence", 3: None, 4: "line", 5: "line", 6: "line", 7: "line", 8: None, 9: None, 10: None, 11: None, 12: None, 13: None}
    by = {d[0]: d[2] for d in docs if d[2]}
    cut = [i for i in by if 1000 <= i < 1060]
    inside = [i for i in cut if by[i].rstrip()[-1] != "."]
    assert sum(i in got for i in inside) >= 0.9 * len(inside) and not any(i in got for i in cut if by[i].rstrip()[-1] == ".")
    assert all(got.get(i) == "mark" for i in range(3000, 3040))
    assert not [i for i in got if 14 <= i < 300 or 2000 <= i < 2200 or 4000 <= i < 4100]


def test_empty(spark, scratch):
    assert found(spark, scratch, []) == {}


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]|[_\n\x01]")


def plain_tokens(text):
    """What Tokens makes of a text, by regular expressions."""
    out = _TOKEN.findall(re.sub(r"\.(?=\w)", "\x01", re.sub(r"\n\s+", "\n", text.replace("\x01", " ").replace("\0", " "))))
    while out and out[-1] == "\n":
        out.pop()
    return out


def test_tokens_and_their_hashes():
    rng = random.Random(9)
    pieces = ["don't", "l’eau", "a''b", "x1y", "12.5", "e.g. no", "Éa", "\n \n\t", "..", "_", "😀ok", "\x01", "日本", " ", "\n", "'", "A", "²", "\0", "end.\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + ["", "\n", " "]
    t = Tokens(texts)
    got: dict[int, list[str]] = {}
    hashes: dict[str, set[int]] = {}
    for of, s, e, kind, h in zip(t.of.tolist(), t.start.tolist(), t.end.tolist(), t.kind.tolist(), t.exact.tolist()):
        token = "\x01" if kind == INNER else texts[of][s - t.first[of] : e - t.first[of]]
        got.setdefault(of, []).append(token)
        hashes.setdefault(token, set()).add(h)
    assert [got.get(i, []) for i in range(len(texts))] == [plain_tokens(x) for x in texts]
    assert all(len(h) == 1 for h in hashes.values()) and len({h for hs in hashes.values() for h in hs}) == len(hashes)
    assert text_hash("don't")[0] in hashes["don't"]
    assert not len(Tokens([]).start) and Tokens(["x" * 100_000]).end[0] == 100_000


def test_tails_are_those_of_the_whole_text():
    rng = random.Random(9)
    texts = [text(rng, rng.randrange(1, 30))[: rng.randrange(5, 2500)].replace(" in ", "\n\nin ") for _ in range(50)] + ["", "word" * 500, "-" * 3000]
    tails, whole = truncation.last_tokens(texts), Tokens(texts)
    for i in range(len(texts)):
        a, b = tails.exact[tails.of == i][-8:].tolist(), whole.exact[whole.of == i][-8:].tolist()
        assert a == b


def test_longer_copies_equal_brute_force(spark, scratch):
    rng = random.Random(13)
    base = ["".join(rng.choice("ab ") for _ in range(rng.choice([5, 31, 32, 40, 127, 128, 300, 700]))) for _ in range(40)]
    texts = sorted({b[: rng.randrange(1, len(b) + 1)] + "".join(rng.choice("ab") for _ in range(rng.choice([0, 0, 1, 7]))) for b in base for _ in range(8)} | {"é" * n for n in range(30, 50)})
    df = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "h binary, text string").repartition(5)
    found = {int(r["h"]): r["behind"] for r in longer_copies(df, scratch).collect()}
    expected = {i for i, a in enumerate(texts) if len(a) >= LEAST and any(b.startswith(a) and b != a for b in texts)}
    assert set(found) == expected and len(expected) > 20
    for i, behind in found.items():
        assert behind and any(t.startswith(texts[i] + behind) for t in texts)
    assert longer_copies(df.limit(0), scratch).count() == 0


def test_long_words_and_repeated_ids(spark, scratch):
    rng = random.Random(14)
    long = "Donaudampfschifffahrtselektrizitaetenhauptbetriebswerk"
    docs = [(i, "mail", text(rng, 3) + f" Bring the {long} today. " + text(rng, 1)) for i in range(200)]
    docs += [(1000 + k, "mail", text(rng, 3) + f" Bring the {long[:k]}") for k in (12, 23, 24, 30, 50)]
    docs += [(7, "mail", text(rng, 2) + " Nobody objected when"), (7, None, text(rng, 2)), (8, "mail", docs[9][2][:-10])]
    df = spark.createDataFrame([(*d, True, 1) for d in docs], "id long, source string, text string, at_limit boolean, state int")
    got = {(r["id"], r["source"]): (r["reason"], r["way"]) for r in truncation.truncated(df, scratch).collect()}
    assert {k: v for k, v in got.items() if k[0] >= 1000} == {(1000 + k, "mail"): ("word", "ends") for k in (12, 23, 24, 30, 50)}
    assert got[7, "mail"] == ("sentence", "ends") and (7, None) not in got and got[8, "mail"][1] == "copy"


def test_copies_of_a_cut_text_are_no_evidence(spark, scratch):
    rng = random.Random(10)
    docs = [(i, "mail", text(rng, 4)) for i in range(300)]
    cut = text(rng, 3) + " Please do not delete the"
    docs += [(1000 + i, "mail", cut) for i in range(150)]
    got = found(spark, scratch, docs)
    assert got == {1000 + i: "sentence" for i in range(150)}


def test_a_last_dot_inside_a_name(spark, scratch):
    rng = random.Random(12)
    docs = [(i, "mail", text(rng, 4) + f" See {rng.choice(NOUNS)}_old.txt and {rng.choice(NOUNS)}_new.csv for it.") for i in range(300)]
    docs += [(1000, "mail", text(rng, 3) + " See garden_old."), (1001, "mail", text(rng, 3) + " See garden_old.txt and roster_new."), (1002, "mail", text(rng, 3))]
    assert found(spark, scratch, docs) == {1000: "word", 1001: "word"}
