"""Language-model scores: the base against counting, the model against plain arithmetic, whole texts, odd inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import attention
from quillstone.llm.common import documents

SMALL = "/root/testdata/sf0.001"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7


@pytest.fixture(scope="module")
def scored(spark):
    return attention.score(documents(spark, SMALL)).collect()


def plain_base(docs):
    """doc_id -> (n_tokens, n_known, N, base) of (doc_id, text) pairs, by one dictionary."""
    words = {}
    for d, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words.setdefault(d, []).append(re.findall(r"[^\x20\x09-\x0D]+", low) + [None])
    counts = Counter(w for d, own in words.items() if d is not None and fold(d) != 2 for t in own for w in t)
    n, v = sum(counts.values()), len(counts)
    return {d: [(len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for t in own] for d, own in words.items()}


def test_base_is_that_of_counting(spark, scored):
    want = plain_base([(r["doc_id"], r["text"]) for r in documents(spark, SMALL).collect()])
    assert len(scored) == len(want)
    for r in scored:
        n, known, total, base = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["held_out"] == (fold(r["doc_id"]) == 2)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_words_outside_the_broadcast_table_are_joined(spark, scored):
    few = {r["doc_id"]: r for r in attention.score(documents(spark, SMALL), frequent=5, rounds=1).collect()}
    for r in scored:
        assert few[r["doc_id"]]["n_known"] == r["n_known"] and few[r["doc_id"]]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)


def small_model(seed=0, classes=70, stride=4):
    rng = np.random.default_rng(seed)
    model = attention.Attention.start(attention.pair_logs(rng.integers(0, 9, (classes + 1, classes)).astype(float)), 6, stride, seed)
    model.weights = {k: (v + rng.standard_normal(v.shape) * 0.4).astype(np.float32) for k, v in model.weights.items()}
    return model


def plain_logs(model, text):
    """Log probabilities of every class of one text, place by place, each in the window that scores it."""
    w, s = {k: v.astype(np.float64) for k, v in model.weights.items()}, model.stride
    before = [len(model.pairs) - 1, *text[:-1]]
    chances = np.exp(model.pairs.astype(np.float64))
    out = []
    for t, want in enumerate(text):
        start = max(0, (t // s - 1) * s)
        seen = before[start : t + 1]
        q = w["embed"][before[t]] @ w["query"] / math.sqrt(w["embed"].shape[1])
        score = np.array([q @ (w["embed"][c] @ w["key"]) + w["near"][t - start - i] for i, c in enumerate(seen)])
        p = np.exp(score - score.max())
        o = sum(a * (w["embed"][c] @ w["value"]) for a, c in zip(p / p.sum(), seen))
        group = np.array([chances[before[t], g : g + attention.GROUP].sum() for g in range(0, chances.shape[1], attention.GROUP)])
        by_group = group * np.exp(o @ w["group"])
        g = want // attention.GROUP
        own = slice(g * attention.GROUP, (g + 1) * attention.GROUP)
        inside = chances[before[t], own] * np.exp(o @ w["out"][:, own])
        out.append(math.log(by_group[g] / by_group.sum()) + math.log(inside[want % attention.GROUP] / inside.sum()))
    return out


@pytest.mark.parametrize("n", [1, 3, 4, 5, 8, 9, 31])
def test_each_place_is_scored_once_with_its_context(n):
    model = small_model(n)
    text = np.random.default_rng(n).integers(0, 70, n).astype(np.int16)
    inputs, targets = attention.windows(text, model.stride, None, len(model.pairs) - 1)
    assert (targets >= 0).sum() == n
    assert model.logs(inputs, targets)[targets >= 0] == pytest.approx(plain_logs(model, text.tolist()), abs=2e-4)


def test_probabilities_add_up_to_one():
    model = small_model(5)
    text = np.array([3, 60, 12, 9, 33, 2], np.int16)
    total = 0.0
    for last in range(70):
        text[-1] = last
        inputs, targets = attention.windows(text, model.stride, None, len(model.pairs) - 1)
        total += math.exp(model.logs(inputs, targets)[targets >= 0][-1])
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_is_the_slope():
    model = small_model(7)
    parts = [attention.windows(np.random.default_rng(i).integers(0, 70, 5 + 9 * i).astype(np.int16), model.stride, None, 70) for i in range(4)]
    inputs, targets = (np.concatenate(x) for x in zip(*parts))
    grad, loss, n = model.gradient(inputs, targets)
    assert n == (targets >= 0).sum() and loss == pytest.approx(-model.logs(inputs, targets).sum())
    for name, weight in model.weights.items():
        flat, at = weight.reshape(-1), int(np.abs(grad[name]).argmax())
        was, step, ends = flat[at], 1e-2, []
        for sign in (1, -1):
            flat[at] = was + sign * step
            ends.append(-model.logs(inputs, targets).sum())
        flat[at] = was
        assert (ends[0] - ends[1]) / (2 * step) == pytest.approx(grad[name].ravel()[at], rel=0.02, abs=1e-2), name


def test_inside_a_class_probabilities_add_up_to_one():
    counts = np.random.default_rng(0).integers(0, 50, attention.END + 1) * (np.arange(attention.END + 1) % 7 == 0)
    kinds = np.arange(attention.END + 1) % 6
    classes = attention.Classes.of_counts(counts, kinds, 20)
    assert classes.size == 27 and classes.of[attention.END] == 20
    assert np.bincount(classes.of, np.exp(classes.inside), 27)[:27] == pytest.approx(np.ones(27))


def by_topic(n, repeats, seed=3):
    """Texts whose words depend on a word long before: the pair table can't know, attention does."""
    rng = np.random.default_rng(seed)
    topics = [x.split() for x in ("north snow ice cold", "desert sand heat sun", "river boat fish rain")]
    fill = "one two three four".split()
    return [(i, " ".join(w for _ in range(repeats) for w in (*rng.choice(fill, 3), rng.choice(topics[i % 3])))) for i in range(n)]


def per_token(spark, docs, rounds):
    rows = [r for r in attention.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), rounds=rounds).collect() if r["held_out"]]
    assert len(rows) > 40
    return sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)


def test_training_helps_on_texts_held_out(spark):
    docs = by_topic(500, 400)
    assert per_token(spark, docs, 12) > 0.97 * per_token(spark, docs, 0)


def test_training_reads_every_window_once(spark, monkeypatch):
    """Over all rounds the gradients have as many targets as the training texts have ids, the long text's included."""
    docs = [*by_topic(60, 5), (1001, "alpha beta gamma " * 30_000)]
    read, step = [], attention.Adam.__call__
    monkeypatch.setattr(attention.Adam, "__call__", lambda self, weights, grad, targets: (read.append(targets), step(self, weights, grad, targets))[1])
    attention.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    subwords = attention.Subwords(None)
    assert sum(read) == sum(len(subwords.ids(text)) for d, text in docs if fold(d) != 2)


def test_training_on_little_does_little_harm(spark):
    docs = by_topic(400, 5)
    assert per_token(spark, docs, 12) > 1.02 * per_token(spark, docs, 0)


def test_model_beats_ids_alone_on_held_out_documents(spark, scored):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, SMALL).collect()}
    subwords = attention.Subwords(None)
    ids = {d: subwords.ids(attention.lowered(t)) for d, t in docs.items()}
    counts = sum(np.bincount(x, minlength=attention.END + 1) for d, x in ids.items() if fold(d) != 2)
    alone = np.log10((counts + 1) / (counts.sum() + len(counts)))
    held = [r for r in scored if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.9 * sum(alone[ids[r["doc_id"]]].sum() for r in held)


def test_long_text_is_scored_whole(spark):
    """In parts of 65,536 ids, as if in one."""
    text = "alpha beta gamma delta " * 40_000
    df = spark.createDataFrame([(1, text), (3, "alpha beta gamma delta"), (4, "alpha " * 50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in attention.score(df, rounds=2).collect()}
    assert got[1]["n_tokens"] == 160_001 and got[1]["score"] < got[3]["score"] < 0
    model = small_model(9)
    own = np.random.default_rng(1).integers(0, 70, 1 << 17).astype(np.int16)
    x, y = attention.windows(own, model.stride, None, 70)
    a, b = attention.windows(own[(1 << 16) - model.stride :], model.stride, None, own[(1 << 16) - model.stride - 1])
    assert model.logs(x, y)[1 << 14 :] == pytest.approx(model.logs(a[1:], b[1:]), abs=1e-4)


def test_odd_inputs(spark, odd_docs, no_docs, clashing):
    assert attention.score(no_docs).collect() == []
    got = attention.score(odd_docs, rounds=1).collect()
    want = plain_base([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert len(got) == odd_docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    for r in got:
        n, known, total, base = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base)
    empty = [r for r in got if r["doc_id"] in (2, 3)]
    assert len({r["score"] for r in empty}) == 1 and all(r["n_tokens"] == 1 for r in empty)
    again = {r["doc_id"]: r for r in attention.score(clashing, rounds=1).collect()}
    assert all(again[r["doc_id"]]["score"] == pytest.approx(r["score"], rel=1e-5) for r in got)
    untaught = attention.score(odd_docs.where("doc_id is null")).collect()
    assert [(r["train_tokens"], r["n_known"], r["held_out"]) for r in untaught] == [(0, 0, False)] and untaught[0]["score"] < 0


def test_long_spaces_and_special_strings():
    subwords = attention.Subwords(None)
    for text in (" " * 9000 + "a", "<|endoftext|> b", "\t" * 3000, "", "é" * 10, "x" * 100_000):
        ids = subwords.ids(text)
        assert ids[-1] == attention.END and b"".join(subwords.pieces[i] for i in ids[:-1]).decode() == text


def test_blocks_hold_each_place_once_and_score_as_windows_do():
    """Before, each place stood in two windows, and was looked up and summed for both. Long texts come in parts with their context."""
    model = small_model(11)
    rng = np.random.default_rng(11)
    texts = [rng.integers(0, 70, n).astype(np.int16) for n in (1, 4, 5, 131, 30, 2, 64)]
    parts = [*attention.blocks(iter(texts), model.stride, 70, most=8)]
    assert sum(int((own.targets >= 0).sum()) for own, _, _ in parts) == sum(map(len, texts))
    assert sum(len(own.inputs) for own, _, _ in parts) <= sum(-(-len(t) // model.stride) for t in texts) + 2 * len(parts)
    scores, whole = np.zeros(len(texts)), attention.Slopes(model)
    for own, numbers, begins in parts:
        np.add.at(scores, numbers, np.add.reduceat(model.run(own, None).sum(axis=1), begins))
        model.run(own, whole)
    assert scores == pytest.approx([sum(plain_logs(model, t.tolist())) for t in texts], abs=5e-3)
    x, y = (np.concatenate(z) for z in zip(*(attention.windows(t, model.stride, None, 70) for t in texts)))
    want, _, _ = model.gradient(x, y)
    for name, slope in whole.of_weights().items():
        assert slope == pytest.approx(want[name], abs=1e-3), name


def encoded(lexicon, texts):
    lows = [t.encode().lower() for t in texts]
    start = len(lexicon.ids)
    numbers = [[*map(lexicon.__getitem__, lexicon.keys_of(low))] for low in lows]
    lexicon.learn()
    out = [[lexicon.ids[i] for i in own] for own in numbers]
    lexicon.forget(start)
    return [None if None in x else np.frombuffer(b"".join(x), "<u2").tolist() for x in out]


def test_ids_word_by_word_are_the_librarys(monkeypatch):
    """Before, the library read every text whole; words seen before are now looked up, and texts with other space still go there."""
    monkeypatch.setattr(attention, "_KNOWN", 20)
    lexicon, rng = attention.Lexicon(attention.Subwords(None)), np.random.default_rng(2)
    bits = ["a", "B", "'s", " ", " ", "  ", "\n", "\t", "1", "9.", "é", "　", "\x1c", "\x85", "!", "漢", "'ll", "<|endoftext|>", " the", "y" * 120]
    plain = [" ".join(rng.choice(["one", "two.", "don't", "x9", "é!", "four\nfive"], 6)) for _ in range(50)]
    for texts in (plain, *(["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(400)] for _ in range(5))):
        for text, ids in zip(texts, encoded(lexicon, texts), strict=True):
            assert ids is None or ids == lexicon.subwords.ids(attention.lowered(text))[:-1].tolist(), text
    assert None not in encoded(lexicon, plain) and len(lexicon) <= 20
    read = []

    class Reader:
        def encode_ordinary(self, text, library=lexicon.subwords.encoding):
            read.append(text)
            return library.encode_ordinary(text)

    lexicon.subwords.encoding = Reader()
    encoded(lexicon, ["one two. one two. one two."] * 100)
    assert len("".join(read)) < 30
