import random

import numpy as np

from kinfold.llm import leakage

NAMES = [f"{a}{b}{c}" for a in "kmt" for b in ("ara", "elo", "ifu", "ost", "und") for c in ("bel", "cor", "dim", "fan", "gul", "hop")]


def passage(rng, n):
    return " ".join(rng.choice(NAMES) for _ in range(n))


def find(spark, scratch, docs, items, **k):
    d = spark.createDataFrame([(*x, "x") for x in docs], "id long, text string, item_id string")
    i = spark.createDataFrame(items, "id long, text string")
    rows = [tuple(r) for r in leakage.leaks(d, i, scratch, **k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_planted_passages(spark, scratch):
    rng = random.Random(6)
    intro = "Read this and answer with one of the words below."
    items = [(i, (intro + " " if i < 5 else "") + passage(rng, 50) + ". What then?") for i in range(9)] + [(20, "too short"), (21, None), (22, "")]
    w = {i: leakage.words(t) for i, t in items}
    fill = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "con"]) for _ in range(n))
    part = lambda i, lo, hi: " ".join(t.split()[lo:hi]) if (t := dict(items)[i]) else ""
    edited = part(5, 10, 40).split()
    edited[9], edited[18] = "changed", edited[18] + " added"
    del edited[26]
    typo = " ".join(x if n % 4 else x[0] + "0" + x[2:] for n, x in enumerate(part(6, 5, 35).split()))
    docs = [
        (1, fill(50) + " " + part(5, 10, 34) + " " + fill(30)), (2, fill(9) + " " + " ".join(edited)), (3, typo.upper()), (4, "<p>> " + part(7, 0, 25).replace(" ", "</b>\n> ") + "</p>"), (5, part(8, 0, 15) + " " + fill(40) + " " + part(8, 30, 40)),
        (6, intro + " " + fill(80)), (7, None), (8, ""), (9, fill(3000) + " " + part(0, 12, 45) + " " + part(1, 12, 45)), (10, part(5, 10, 34)), (11, " ".join(NAMES)), (12, " ".join(x for n, x in enumerate(part(5, 0, 50).split()) if n % 3)),
    ]
    expected = {(1, 5), (2, 5), (3, 6), (4, 7), (9, 0), (9, 1), (10, 5)}
    assert len(w[0]) > 50 and find(spark, scratch, docs, items) == expected
    assert find(spark, scratch, docs, items, words_a_pass=200) == expected
    assert find(spark, scratch, [], items) == set() and find(spark, scratch, docs, []) == set()


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = random.Random(7)
    known = NAMES
    items = [(i, np.array([rng.randrange(len(known)) for _ in range(40)], dtype=np.int32)) for i in range(30)]
    index = leakage.Index(items, known, np.ones(len(known)))
    doc = np.concatenate([items[3][1][:25], items[9][1][5:35], np.array([rng.randrange(len(known)) for _ in range(60)], dtype=np.int32)])
    prints = index.fingerprints(doc)
    brute = {(p, int(j)) for p, x in enumerate(prints) for j in np.flatnonzero(np.bitwise_count(index.prints ^ x) <= leakage.RADIUS)}
    assert {(i, j) for i, j in zip(*(x.tolist() for x in index.within(prints)))} == brute and len(brute) > 30
    # far fewer comparisons than all with all
    other = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    before = index.compared
    index.within(other)
    assert index.compared - before < 0.004 * len(other) * len(index.prints)


def test_every_accepted_stretch_has_a_window_with_enough_pairs():
    rng = random.Random(12)
    item = np.arange(100, 160)
    accepted = 0
    for _ in range(6000):
        lo, n = rng.randrange(0, 15), rng.randrange(20, 46)
        part, k = list(range(lo, lo + n)), 0
        while k < len(part):
            if rng.random() < 0.16:
                how = rng.randrange(3)
                if how == 0:
                    part[k] = None
                elif how == 1:
                    part.insert(k, None)
                    k += 1
                else:
                    del part[k]
            k += 1
        codes = np.array([-1] * 12 + [-1 if x is None else item[x] for x in part] + [-1] * 12)
        if leakage.aligned_span(codes, item):
            accepted += 1
            pairs = ((codes[1:] - codes[:-1] == 1) & (codes[1:] > 0) & (codes[:-1] > 0)).astype(int)
            assert max(pairs[i : i + 9].sum() for i in range(len(pairs) - 8)) >= leakage.PAIRS
            assert max(pairs[i : i + 23].sum() for i in range(len(pairs) - 22)) >= leakage.STRETCH_PAIRS
    assert accepted > 300


def test_openings_are_told_from_passages(spark, scratch):
    rng = random.Random(15)
    intro = "Look at the following account and then answer what is asked about it in one word or in two words please."
    passages = [passage(rng, 24) + ". " + passage(rng, 30) + "." for _ in range(2)]
    items = [(i, f"{passages[0]} {q}?") for i, q in enumerate(("who is kara", "where was that", "what for", "when then"))]
    items += [(10 + i, f"{intro} {passage(rng, 30)}. And why?") for i in range(4)] + [(20, f"{intro} {passages[1]} Who?")]
    docs = [(1, "so " + passages[0].split(".")[0] + " it was"), (2, intro + " No more."), (3, passages[1])]
    assert find(spark, scratch, docs, items) == {(1, 0), (1, 1), (1, 2), (1, 3), (3, 20)}


def test_passes_and_codings_give_the_same(spark, scratch):
    rng = random.Random(16)
    items = [(i, passage(rng, 45)) for i in range(40)]
    docs = []
    for d in range(120):
        i, lo = rng.randrange(40), rng.randrange(20)
        part = items[i][1].split()[lo : lo + 25]
        for k in (4, 13, 20)[: rng.randrange(4)]:
            part[k] = rng.choice(["other", part[k][:-1], part[k] + "x"])
        docs.append((d, " ".join(["well", *part, "and", "so"])))
    one = find(spark, scratch, docs, items)
    assert len(one) > 80
    assert one == find(spark, scratch, docs, items, words_a_pass=300) == find(spark, scratch, docs, items, words_a_pass=46)


def test_alignment():
    item = np.arange(40)
    same = np.arange(5, 30)
    assert leakage.aligned_span(same, item) == 25
    assert leakage.aligned_span(np.delete(same, 12), item) == 25
    assert leakage.aligned_span(np.insert(same, 12, 99), item) == 25
    two = same.copy()
    two[[8, 9]] = -1  # two changed words in a row end the stretch
    assert leakage.aligned_span(two, item) == 0
    often = same.copy()
    often[::4] = -1
    assert leakage.aligned_span(often, item) == 0


def test_edits_anywhere_in_a_short_stretch():
    item = np.arange(100, 160)
    for length, edits in ((20, [1]), (20, [2]), (20, [18]), (21, [3]), (20, [4, 12]), (21, [2, 18]), (25, [3, 11, 19])):
        changed = item[7 : 7 + length].copy()
        changed[edits] = -1
        dropped = np.delete(item[7 : 7 + length], edits)
        for part in (changed, dropped):
            assert leakage.aligned_span(np.concatenate([[-1, -1], part, [-1, -1]]), item) == length
    assert leakage.aligned_span(item[7:26], item) == 0
    # two edits in 22 words: a passage, unless numbers differ as in another text of the pattern
    part, number = item[7:29].copy(), np.zeros(1000, dtype=bool)
    part[[5, 16]] = -1
    assert leakage.aligned_span(part, item, number) == 22
    number[[item[23], -2]] = True
    part[16] = -2
    assert leakage.aligned_span(part, item, number) == 0


def test_misspelt_words_stand_for_all_words_a_letter_away(spark, scratch):
    # each word of the first item has a neighbour a letter away in the second, earlier in the alphabet
    rng = random.Random(11)
    right = ["".join(rng.choice("bdfgk") + rng.choice("aeiou") for _ in range(3)) + "z" for _ in range(30)]
    items = [(1, " ".join(right)), (2, " ".join(x[:-1] + "c" for x in reversed(right)))]
    for doc in ([x[:-1] + "m" for x in right], [x if n % 3 else x[:-1] + "c" for n, x in enumerate(right)]):
        assert (1, 1) in find(spark, scratch, [(1, "some words " + " ".join(doc))], items)
