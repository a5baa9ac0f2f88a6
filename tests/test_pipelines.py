"""The composed retrieval pipelines against a plain replay, question by question."""

import math
import random
from collections import Counter

import pytest

from quillstone.operators import knowledge, pipelines


def plain_bm25(question, texts, k1=1.5, b=0.75, epsilon=0.25):
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    df = Counter(w for own in words for w in set(own))
    idf = {w: math.log((len(words) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf) if idf else 0.0
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    out = []
    for own in words:
        tf = Counter(own)
        out.append(round(sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(own) / mean)) for w in question.split() if w in tf), 6))
    return out


def plain_merge(question, texts, k):
    """Places from 0 in the order of the merged list, and each one's keyword rank."""
    scores = plain_bm25(question, texts)
    by_word = sorted(range(len(texts)), key=lambda i: (-scores[i], i))
    seen, out = set(), []
    for i in list(range(len(texts)))[: 2 * k]:
        if texts[i][:200] not in seen:
            seen.add(texts[i][:200])
            out.append(i)
    for i in by_word[: 2 * k]:
        if texts[i][:200] not in seen and len(out) < 3 * k:
            seen.add(texts[i][:200])
            out.append(i)
    return out, {i: r for r, i in enumerate(by_word, 1)}, scores


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    out = []
    for q in range(8):
        n = rng.choice([1, 2, 7, 30, 50])
        texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]
        for _ in range(n // 4):
            texts[rng.randrange(n)] = texts[rng.randrange(n)] + rng.choice(["", " tail"])
        out.append((q, " ".join(rng.choice([*vocabulary, "unknown"]) for _ in range(rng.choice([0, 3, 12]))), rng.choice([1, 4, 9, 15]), texts))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merged_list_is_that_of_a_plain_replay(spark, seed):
    given = cases(seed)
    rows = [(q, question, k, 100 * q + (7 * i) % 97, i + 1, 1 - i / 100, t) for q, question, k, texts in given for i, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "qid long, question string, k int, id long, place int, score double, content string").repartition(4)
    got = {}
    for r in pipelines.combined(found).collect():
        got.setdefault(r["qid"], []).append((r["ord"], r["place"] - 1, r["keyword_rank"], r["bm25"]))
    for q, question, k, texts in given:
        order, ranks, scores = plain_merge(question, texts, k)
        assert [x[1] for x in sorted(got[q])] == order
        assert all(ranks[i] == rank and scores[i] == pytest.approx(score, abs=2e-6) for _, i, rank, score in got[q])


def vectors(rng, n):
    return [[rng.gauss(0, 1) for _ in range(6)] for _ in range(n)]


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(4)
    kinds = ["text", "complete_table", "table_row", "table_cell", "footnote", None]
    chunks = [(i, f"part {i % 9} of the cover has a limit of {i}0 % and an excess of {i * 7 % 13} for plan {i % 4}", v, i % 2, kinds[i % 6], i % 5 / 2, f"t{i % 3}" if i % 4 else None, None, i % 7 == 0) for i, v in enumerate(vectors(rng, 160))]
    chunks.append((900, None, [1.0] * 6, 0, "text", 0.0, None, None, False))
    questions = [(q, f"what is the limit of the cover for plan {q % 4} and part {q}", v, q % 3) for q, v in enumerate(vectors(rng, 9))]
    c = spark.createDataFrame(chunks, "id long, content string, v array<double>, doc long, element_type string, importance double, table_id string, parent_id string, has_money boolean")
    return spark.createDataFrame(questions, "qid long, question string, v array<double>, doc long"), c, chunks, questions


def cosine(a, b):
    return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)


def test_pipelines_by_name(store):
    assert knowledge.pipeline() is knowledge.pipeline("traditional") is pipelines.TRADITIONAL
    assert knowledge.pipeline("structure_aware") is pipelines.STRUCTURE_AWARE
    with pytest.raises(KeyError):
        knowledge.pipeline("other")


@pytest.mark.parametrize("k", [2, 5, 30])
def test_static_k_end_to_end(store, k):
    questions, chunks, rows, asked = store
    run = knowledge.pipeline("traditional")(questions, chunks, k)
    got = {}
    for r in run.documents.collect():
        got.setdefault(r["qid"], []).append((r["place"], r["id"]))
    most = max(50, 3 * k)
    for q, question, v, doc in asked:
        near = sorted(((-cosine(v, c[2]), c[0], c[1]) for c in rows if c[3] == doc))[:most]
        near = [x for x in near if x[2] is not None]
        order = plain_merge(question, [x[2] for x in near], k)[0] if near else []
        assert [i for _, i in sorted(got.get(q, []))] == [near[i][1] for i in order[:k]], q
    answers = {r["qid"]: r for r in run.answers().collect()}
    assert set(answers) == {q for q, _, _, doc in asked if doc < 2}
    assert all(r["kept"] <= k and r["reason"] == "static" and r["merged"] <= 3 * k for r in answers.values())


def test_dynamic_k_bounds_and_structured_order(store):
    questions, chunks, rows, asked = store
    run = knowledge.pipeline("structure_aware")(questions, chunks)
    kept = run.documents.collect()
    by = {}
    for r in kept:
        by.setdefault(r["qid"], []).append(r)
    stats = {r["qid"]: r for r in run.answers().collect()}
    for q, own in by.items():
        assert 4 <= stats[q]["k"] <= 15 and len(own) == stats[q]["kept"] <= stats[q]["k"]
        assert sorted(r["place"] for r in own) == list(range(1, len(own) + 1))
        assert stats[q]["candidates"] <= max(60, 4 * stats[q]["k"])
    assert {r["qid"] for r in kept} == {q for q, _, _, doc in asked if doc < 2}


def test_short_lists_keep_the_order_of_types(spark):
    found = spark.createDataFrame([(1, "q", 10, i, i + 1, 1.0, f"text {i}", t, imp, None, None, False) for i, (t, imp) in enumerate([("text", 9.0), ("footnote", 1.0), (None, None), ("complete_table", 2.0), ("footnote", 3.0)])],
                                  "qid long, question string, k int, id long, place int, score double, content string, element_type string, importance double, table_id string, parent_id string, has_money boolean")
    got = [r["id"] for r in sorted(pipelines.structured(pipelines.combined(found)).collect(), key=lambda r: r["place"])]
    assert got == [4, 1, 3, 0, 2]


def test_context_is_marked_by_type(spark):
    rows = [(1, 1, "b", "text", None), (1, 2, "row", "table_row", "T1"), (1, 3, "whole", "complete_table", None), (1, 4, "a", None, "x"), (1, 5, "note", "footnote", None), (2, 1, "only", "table_cell", "B2"), (3, 1, "odd", "picture", None)]
    df = spark.createDataFrame(rows, "qid long, place int, content string, element_type string, label string")
    got = {r["qid"]: r["context"] for r in pipelines.tagged_context(df).collect()}
    assert got == {
        1: "[COMPLETE TABLE - Policy Table]\nwhole\n[/COMPLETE TABLE]\n\n[TABLE ROW - T1]\nrow\n[/TABLE ROW]\n\n[FOOTNOTE *]\nnote\n[/FOOTNOTE]\n\n[POLICY TEXT]\nb\n\na\n\n[/POLICY TEXT]",
        2: "[TABLE CELL - B2]\nonly\n[/TABLE CELL]\n",
    }
