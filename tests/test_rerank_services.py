"""Services that fail, answer in part, or for nobody."""

import pytest

from quillstone.operators import rerank


def _services():
    """Made inside a function, so that they are sent to the workers as they are."""

    def down(question, texts):
        raise TimeoutError

    def picky(question, texts):
        if question == "hard":
            raise ValueError
        return [(1, 0.5), (0, 0.5), (7, 0.9)]  # a place that nobody has

    return down, picky


down, picky = _services()


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(1, "easy one", 10, 2, "one"), (1, "easy one", 11, 1, "easy one"), (1, "easy one", 12, 3, None), (2, "hard", 20, 1, "x"), (2, "hard", 21, 2, "hard"), (3, None, 30, 1, "x")]
    return spark.createDataFrame(rows, "qid int, question string, id int, rank int, content string").repartition(3)


def of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], []).append((r["place"], r["id"], r["service"], None if r["score"] is None else round(r["score"], 6)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_the_first_that_answers(candidates):
    got = of(rerank.rerank_by(candidates, {"down": down, "picky": picky}, 5))
    assert got[1] == [(11, "picky", 0.5), (10, "picky", 0.5)]  # ties by rank; what it leaves out stays out
    assert got[2] == [(21, "words", 1.0), (20, "words", 0.0)]
    assert got[3] == [(30, "picky", 0.5)]


def test_words_are_the_default_and_none_keeps_the_order(candidates):
    assert of(rerank.rerank_by(candidates, {"down": down}, 2))[1] == [(11, "words", 1.0), (10, "words", 0.5)]
    assert of(rerank.rerank_by(candidates, {"down": down}, 2, None))[1] == [(11, None, None), (10, None, None)]
    assert rerank.rerank_by(candidates.limit(0), {"down": down}, 2).count() == 0
