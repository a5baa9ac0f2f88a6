"""Passages found, verified a second time over strings and sets, by none of the operator's own code; and texts with very many moved passages."""

import random
import time

import numpy as np
import pytest

from quillstone.llm import common, passages

MORE = "/root/testdata/sf0.01"


def shingles(text):
    """Five-word shingles as strings, A-Z in lower case, words between the six ASCII white spaces."""
    words = text.encode().lower().split()
    return [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def alike_somewhere(own, other, similar=0.8):
    """Whether a stretch of ``other`` has a Jaccard similarity of at least ``similar`` with the set ``own``: from every shared shingle on, one by one."""
    most = int(len(own) / similar) + 1
    for i in (i for i, s in enumerate(other) if s in own):
        seen, both = set(), 0
        for s in other[i : i + 3 * most]:
            if s not in seen:
                seen.add(s)
                both += s in own
            if len(seen) > most:
                break
            if both >= similar * (len(own) + len(seen) - both) - 1e-9:
                return True
    return False


def test_every_repeat_is_alike_by_words(spark):
    docs = common.documents(spark, MORE)
    texts = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    found = passages.repeats(docs).collect()
    assert len(found) > 100
    for r in found:
        n = r["n_words"] - 4
        own = texts[r["doc_id"]][r["start_word"] : r["start_word"] + n]
        assert len(own) == n >= 46 and r["first_id"] < r["doc_id"]
        assert alike_somewhere(set(own), texts[r["first_id"]]), r


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_many_moved_passages_are_found_in_little_time():
    rng = random.Random(2)
    parts = [words(rng, 60) for _ in range(1600)]
    moved = parts[:]
    rng.shuffle(moved)
    shingler = passages.Shingler()
    a, b = (shingler(" ".join(w for p in x for w in p)) for x in (parts, moved))
    began = time.process_time()
    found = passages.stretches(a, b)
    assert time.process_time() - began < 5
    covered = np.zeros(len(a), bool)
    for lo, hi, likeness in found:
        covered[lo : hi + 1] = True
        assert likeness >= 0.8
    assert len(found) <= 1600 and all(covered[60 * i : 60 * i + 56].all() for i in range(1600))


@pytest.mark.parametrize("between", [0, 700, 2000])
def test_a_chain_goes_on_over_any_number_of_runs(between):
    """A passage whose second half stands far behind many short runs shared with other places is one passage still."""
    rng = random.Random(between)
    left, right = words(rng, 400), words(rng, 400)
    loose = [words(rng, 6) for _ in range(between)]
    a = left + right
    text_a = " ".join(a)
    # in the other text: the passage, and behind it the loose runs, which the first text has before it in another order
    text_b = " ".join(left + right + [w for x in loose for w in [*x, *words(rng, 2)]])
    before = " ".join(w for x in reversed(loose) for w in [*x, *words(rng, 3)])
    shingler = passages.Shingler()
    found = passages.stretches(shingler((before + " " + text_a).strip()), shingler(text_b))
    assert any(hi - lo + 5 >= 800 for lo, hi, _ in found)


def plain_chain(p, q, n):
    """The greatest weight of a chain, trying every run before each."""
    weight = []
    for j in range(len(p)):
        best = 0.0
        for i in range(j):
            if q[i] < q[j] and q[i] + n[i] < q[j] + n[j]:
                apart = q[j] - q[i] - n[i]
                best = max(best, weight[i] - 0.1 * (p[j] - p[i] - n[i] + max(apart, 0)) + min(apart, 0))
        weight.append(n[j] + best)
    return max(weight)


@pytest.mark.parametrize("seed", range(8))
def test_the_weightiest_chain_is_that_of_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 40, 60)
    p = np.cumsum(n + rng.integers(1, 30, 60)) - n
    q = rng.integers(0, 3000, 60) if seed % 2 else np.maximum(0, p + rng.integers(-60, 60, 60))
    chains, rest = passages._chains(p, q, n)
    weight = lambda c: sum(n[c]) - sum(0.1 * (p[j] - p[i] - n[i] + max(q[j] - q[i] - n[i], 0)) - min(q[j] - q[i] - n[i], 0) for i, j in zip(c, c[1:]))
    assert weight(chains[0][0]) == pytest.approx(plain_chain(p.tolist(), q.tolist(), n.tolist()))
    runs = [i for chain, total in chains for i in chain] + rest
    assert sorted(runs) == list(range(60)) and all(total == n[chain].sum() for chain, total in chains)
