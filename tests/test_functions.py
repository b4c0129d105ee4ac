"""Hand-computed values of the functions."""

import pytest
from pyspark.sql import functions as F

from kinfold.functions import kinds, measures, text

S = F.lit


def cases():
    NONE = F.lit(None).cast("string")
    return [
        (text.trunc(S("abcde"), 5), "abcde..."), (text.trunc(S("abcd"), 5), "abcd"), (text.trunc(NONE, 5), None), (text.trunc(S(""), 5), ""),
        (text.edit_distance(NONE, S("x")), 1000), (text.edit_distance(S("ab"), S("ba")), 2),
        (text.bigram_similarity(NONE, S("ab")), 0.0), (text.bigram_similarity(S("a"), S("a")), 0.0), (text.bigram_similarity(S("ABC"), S("abd")), 1 / 3),
        (text.token_similarity(S("IMG_001.jpg"), S("IMG_002.jpg")), 0.5), (text.copy_name(S("a.b.txt")), "a.b_copy.txt"), (text.copy_name(S("a")), "a_copy"),
        (text.extension(S("a.B")), "B"), (text.extension(S("a")), None), (text.prefixes(S("Abc"), 2, 6), ["ab", "abc"]), (text.prefixes(S("a")), []),
        (text.folder_names(S("/a/b/x")), ["a", "b"]), (text.folder_names(S("/x")), []), (text.clean_header(S(" Größe (m) ")), "größem"),
        (text.natural_key(S("Img10.png")) > text.natural_key(S("img9.png")), True), (text.size_text(F.lit(0.0)), "---"), (text.size_text(F.lit(1500.0)), "1.5 Kb"), (text.size_text(F.lit(2.5e9)), "2.5 Gb"),
        (text.words(S("Ä_b c-1")), ["ä_b", "c", "1"]), (text.strip_markup(S("<p>a<script>x</script> &amp; b</p>")), "a & b"), (text.text_tokens(S("a b-c"), 2, 1), ["a", "b"]),
        (measures.path_distance(S("/a/b/x"), S("/a/c/y")), 2), (measures.path_distance(S("/a/x"), S("/a/y")), 0), (measures.path_distance(S("/a/x"), S("/y")), 1), (measures.path_distance(NONE, S("/y")), None),
        (measures.near_miss(F.lit(0.6)), True), (measures.near_miss(F.lit(0.4)), True), (measures.near_miss(F.lit(None).cast("double")), False),
        (measures.balanced(F.lit(1.0), F.lit(0.5)), 1 / 1.75), (measures.balanced(F.lit(0.0), F.lit(0.5)), 0.0), (measures.scaled("size_dist", F.lit(0.0)), 1.0), (measures.scaled("bin_simil", F.lit(float("nan"))), None),
        (measures.color_difference(F.array(*map(F.lit, (0, 0, 0))), F.array(*map(F.lit, (3, 6, 9)))), 6.0), (measures.color_difference(F.array(*map(F.lit, (-1, -1, -1))), F.array(*map(F.lit, (1, 2, 3)))), 0.0),
        (measures.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 0.0), (measures.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))), 5.0),
        (kinds.kind(S("heic")), "media"), (kinds.kind(NONE), "other"), (kinds.name_kind(S("dir/~a.txt")), "other"), (kinds.name_kind(S("a.DHTML")), "web"), (kinds.name_kind(S(".txt")), "other"),
        (kinds.pair_kind(S("image"), S("text")), "all_other"),
    ]


def test_values(spark):
    some = cases()
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(some))).first()
    for i, (_, expected) in enumerate(some):
        assert row[i] == (pytest.approx(expected) if isinstance(expected, float) else expected), i
