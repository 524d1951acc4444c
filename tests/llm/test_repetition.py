"""Repetition takes part in the verdict on a text, also where its sentences read as prose."""

from trellis.llm import quality

COMMON = ["the", "of", "to", "and", "in", "was", "a"]


def test_repeated_phrases_are_no_prose(spark):
    words = "quick brown foxes jumped over seven lazy dogs while nobody watched them near an old mill that stood beside the river"
    texts = {
        "phrase": "walk slowly to the bridge " * 3,
        "short": "go to the mill go to the mill",
        "lines": "We went down to the harbour at noon.\n" + "Nobody was there in the end.\n" * 2 + "Gulls were crying over the empty boats.\n" * 2,
        "prose": f"In the morning {words}. It was a long day, and the people of the village went home to rest.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    got = {r.doc_id: r for r in quality.quality(df, "doc_id", "text", common).collect()}
    assert all(got[k].prose_share >= 0.5 for k in ("phrase", "short", "lines", "prose"))  # by sentences alone all are prose
    assert {k: r.is_prose for k, r in got.items()} == {"phrase": False, "short": False, "lines": False, "prose": True}
