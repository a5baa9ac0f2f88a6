"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from quillstone.llm import common, fm, jpeg, langid, licenses, mixing, packing, passages, registry, simhash, spotsigs

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SMALL)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# --- mixing ---


@pytest.mark.parametrize("seed", range(5))
def test_period_keeps_every_source_within_a_block(seed):
    rng = random.Random(seed)
    shares = mixing.rounded_shares({f"s{i}": rng.random() ** 3 + 1e-4 for i in range(rng.randint(1, 40))})
    period = sum(shares.values())
    slots = mixing.one_period(shares)
    assert sorted(x for v in slots.values() for x in v) == list(range(period))
    for s, own in slots.items():
        for k, slot in enumerate(own):
            assert k * period // shares[s] <= slot < -(-(k + 1) * period // shares[s])
    taken = dict.fromkeys(shares, 0)
    owner = {x: s for s, v in slots.items() for x in v}
    for t in range(period):
        taken[owner[t]] += 1
        assert all(abs(taken[s] - shares[s] * (t + 1) / period) < 1 for s in shares)


@pytest.mark.parametrize(
    "weights",
    [registry.WEIGHTS | {"": registry.REST}, {"a": 1 / 3, "b": 1 / 7, "c": 2.0}, {"a": 1e-5, "b": 1.0}, {"a": 0.333, "b": 0.1999, "c": 0.4671}, {f"s{i}": i + 1 for i in range(50)}],
)
def test_mix_stays_within_a_block_of_the_given_weights(weights):
    """Over a million slots, against the weights themselves."""
    slots = 1_000_000
    whole = sum(weights.values())
    plan = mixing.phases(dict.fromkeys(weights, slots), weights)[0]
    assert plan["start"] == 0 and plan["length"] >= slots
    period, t = plan["whole"], np.arange(1, slots + 1)
    for s, own in plan["slots"].items():
        once = np.zeros(period, np.int64)
        once[own] = 1
        taken = np.cumsum(np.resize(once, slots))
        assert np.abs(taken - t * (weights[s] / whole)).max() < 1 + 1e-6


def test_weights_without_a_small_denominator_are_rounded_within_the_bound():
    weights = {"a": 0.123456789, "b": 0.3, "c": 1e-9}
    plan = mixing.phases(dict.fromkeys(weights, 10**6), weights)[0]
    assert plan["whole"] == mixing.LONGEST_PERIOD and plan["shares"]["c"] == 1
    assert abs(plan["shares"]["a"] / plan["whole"] - 0.123456789 / 0.423456790) < 2 / mixing.LONGEST_PERIOD


def test_mix_is_a_plain_simulation(spark):
    sizes = {"a": 95, "b": 40, "c": 7, None: 20}
    docs = spark.createDataFrame([(i * 4 + j, s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, source string").repartition(3)
    weights = {"a": 0.5, "b": 0.3, "c": 0.1, "absent": 5.0}
    got = mixing.mix(docs, weights, rest=0.1, block_docs=4, period=50).collect()
    assert len(got) == sum(sizes.values())
    blocks = {"a": 24, "b": 10, "c": 2, "": 5}
    left, order, start = dict(blocks), [], 0
    done = dict.fromkeys(blocks, 0)
    while left:
        shares = mixing.rounded_shares({s: {"a": 0.5, "b": 0.3, "c": 0.1, "": 0.1}[s] for s in left}, 50)
        released, t = dict.fromkeys(left, 0), 0
        phase = True
        while phase:
            open_ = [(-(-(released[s] + 1) * 50 // shares[s]), s) for s in left if released[s] * 50 // shares[s] <= t]
            _, s = min(open_)
            order.append((start + t, s, done[s]))
            released[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
            if not left[s]:
                del left[s]
                phase = False
        start += t
    assert {(r["slot"], r["stream"], r["block"]) for r in got} == set(order)
    assert {r["source"] for r in got} == {"a", "b", "c", ""}
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_in_order_follows_the_mix(docs):
    place = {r["doc_id"]: (r["slot"], r["position"]) for r in mixing.mix(docs, registry.WEIGHTS, registry.REST).collect()}
    ids = [r["doc_id"] for r in mixing.in_order(docs, registry.WEIGHTS, registry.REST).collect()]
    assert ids == sorted(place, key=place.get)


# --- quality ---


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(1)
    found = [(np.array([1, 5, 9]), np.array([0.5, 0.2, 0.1], np.float32), rng.random(len(fm.STRUCTURE)).tolist()) for _ in range(3)]
    m = fm.train(found, np.array([0, 1, 1], np.float32), buckets=16)
    slots, values, starts = m.rows(found)
    raw, _ = m.raw(slots, values, starts)
    ends = [*starts[1:], len(slots)]
    for i, (s, e) in enumerate(zip(starts, ends)):
        v = m.factors[slots[s:e]] * values[s:e, None]
        pairs = sum(float(v[a] @ v[b]) for a in range(len(v)) for b in range(a))
        assert raw[i] == pytest.approx(m.bias + float(m.linear[slots[s:e]] @ values[s:e]) + pairs, abs=1e-4)


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in common.documents(spark, MORE, "labels").collect()}
    rows = registry.op3_quality_fm(spark, MORE).collect()
    assert len(rows) == 1000 and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in known]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


# --- packing ---


def test_pack_round_trip(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary()[0])
    got = packing.pack(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for doc_id, pieces in by.items():
        pieces.sort(key=lambda r: r["start"])
        ids = whole.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        assert [x for r in pieces for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in pieces)
    assert by.keys() == texts.keys()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)


def test_special_strings_and_long_spaces_are_the_librarys_own():
    encoder = packing.Encoder(*packing.vocabulary())
    for text in ("a<|endoftext|>b", " " * 50_000 + "x", "", "é漢🙂\n\n\t x"):
        assert encoder.ids(text) == encoder.whole.encode(text, add_special_tokens=False).ids


# --- fingerprints ---


def signatures(text):
    anchors = set(spotsigs.ANCHORS.split())
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    parts, run = [], None
    for w in words:
        if w in anchors:
            run = w
        else:
            parts.append((run, w))
            run = None
    parts += [(run, ""), (None, ""), (None, "")]
    found = {(a, w, parts[i + 1][1], parts[i + 2][1]) for i, (a, w) in enumerate(parts) if a and i + 2 < len(parts)}
    return found or {tuple(words)}


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_edited_texts(docs, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in spotsigs.compare_edited(docs).collect()}
    prints = {}
    for i, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(likeness(signatures(text), signatures(edited)))
        assert r["near_next"] == pytest.approx(likeness(signatures(text), signatures(following)))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_parts_follow_each_other(docs, texts):
    base = docs.select("doc_id", "text")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(base, rows_a_part=7).collect()}
    ids = sorted(texts)
    assert got == {d: texts[ids[(i + 1) % len(ids)]] for i, d in enumerate(ids)}


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_parts_are_even_and_in_order_whatever_the_ids(spark, ranges):
    """Dense ids, far ones, one id on a third of all rows, rows without an id."""
    rows = [(i, f"t{i}") for i in range(400)] + [(10**9 + i * 10**7, f"u{i}") for i in range(200)] + [(300, f"v{i}") for i in range(400)] + [(None, f"n{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tied = docs.selectExpr("doc_id", "text", "xxhash64(text) tie")
    got = tied.withColumn("part", spotsigs.parts_of(tied, 20, ranges)).collect()
    order = sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tie"]))
    assert [r["part"] for r in order] == sorted(r["part"] for r in got)
    if ranges == 256:
        assert max(Counter(r["part"] for r in got).values()) < 200
    following = {r["text"]: r["next_text"] for r in spotsigs.with_next(docs, 20, ranges).collect()}
    texts = [r["text"] for r in order]
    assert following == dict(zip(texts, [*texts[1:], texts[0]], strict=True))


def test_texts_without_an_anchor_have_prints_of_their_own(spark):
    docs = spark.range(200_000).selectExpr("id doc_id", "concat('zzz', id) text")
    assert spotsigs.with_signatures(docs, "text", "s").select("s").distinct().count() == 200_000


def test_similar_pairs_lose_none(docs, texts):
    members, pairs = spotsigs.similar_pairs(docs, 0.8)
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    found = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    sets = {d: signatures(t) for d, t in texts.items()}
    classes = sorted(set(of.values()))
    want = {frozenset((a, b)) for i, a in enumerate(classes) for b in classes[i + 1 :] if likeness(sets[a], sets[b]) >= 0.8}
    assert want == found
    assert all((of[a] == of[b]) == (sets[a] == sets[b]) for a in texts for b in texts)


# --- licenses ---


def test_base_places(docs, texts):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for doc_id, text in texts.items():
        low = text.translate({i: i + 32 for i in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_labels_scores_and_spans_of_the_query(spark, texts):
    """Near notices by a word-for-word search with edit distance, over planted ones and the small table."""
    rng = random.Random(6)
    planted = {10**6 + i: text for i, text in enumerate(planted_notices(rng))}
    docs = spark.createDataFrame([*texts.items(), *planted.items()], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        text = planted.get(r["doc_id"], texts.get(r["doc_id"]))
        scanner = licenses.Scanner(licenses.NOTICES, licenses.BASE)
        joined = scanner.words(text or "")
        words = joined.decode("utf-8", "surrogatepass").split()
        base = {x for x in r["base_labels"].split(",") if x}
        near = {s["label"] for s in r["spans"]}
        assert set(filter(None, r["labels"].split(","))) == base | near
        for s in r["spans"]:
            notice = next(n for n in licenses.NOTICES if n.label == s["label"] and s["edits"] <= n.edits)
            assert 0 <= s["word"] and s["word"] + s["words"] <= len(words) and notice
        if r["n_base"]:
            assert r["score"] == 1.0
        elif r["spans"]:
            assert 0 < r["score"] <= 1
        else:
            assert r["score"] == 0
    got = {r["doc_id"]: r for r in licenses.scan(docs).where("doc_id >= 1000000").collect()}
    assert all(got[d]["labels"] for d in planted)


def planted_notices(rng):
    """Each notice once as it is and once with as many letters changed as its bound allows, among other words."""
    for notice in licenses.NOTICES:
        phrase = notice.words
        for edits in (0, notice.edits):
            letters = list(phrase)
            for i in rng.sample([i for i, c in enumerate(letters) if c.isalpha()], edits):
                letters[i] = "z" if letters[i] != "z" else "y"
            yield "some words before " + "".join(letters) + " and some after"


def test_edits_within_the_bound_are_found_and_no_more():
    scanner, rng = licenses.Scanner(), random.Random(3)
    for notice, length, _, _ in scanner.notices:
        for edits in (0, notice.edits, notice.edits + 6):
            chars = list(notice.words)
            for at in rng.sample([i for i, c in enumerate(chars) if c != " "], edits):
                chars[at] = "z"
            joined = scanner.words("some text before " + "".join(chars) + " and after")
            near = [x for x in scanner.near(joined) if x[0] == notice.label]
            whole = regex.search("(?:" + regex.escape(notice.words) + "){e<=%d}" % notice.edits, joined.decode())
            assert bool(near) == bool(whole)
            if edits <= notice.edits:
                assert any(x[1] == 3 and x[3] <= edits for x in near), (notice, near)


# --- JPEG ---


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def symbol(self, s):  # every symbol has nine bits
        self.put(s, 9)

    def scan(self, head):
        return jpeg._scan(head, [np.array(self.bits, np.uint8)])


def _size(v):
    return abs(v).bit_length()


def _extra(w, v):
    n = _size(v)
    w.put(v if v > 0 else v + (1 << n) - 1, n)


def progressive(coefficients, wide, high):
    """A general progressive encoder for one component: two DC scans, two AC bands in two passes each."""
    table = lambda kind: bytes([kind << 4]) + bytes([0] * 8 + [255, 1] + [0] * 6) + bytes(range(256))
    # 255 codes of nine bits, then one of ten for symbol 255, which is not used
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + b"\x01" * 64), jpeg._segment(0xC2, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\x01\x11\x00"), jpeg._segment(0xC4, table(0) + table(1))]
    shifted = lambda v: abs(int(v)) >> 1 if v >= 0 else -(abs(int(v)) >> 1)
    w, before = Writer(), 0
    for block in coefficients:
        dc = int(block[0]) >> 1
        w.symbol(_size(dc - before))
        _extra(w, dc - before) if dc != before else None
        before = dc
    out.append(w.scan(bytes([1, 1, 0, 0, 0, 1])))
    w = Writer()
    for block in coefficients:
        w.put(int(block[0]) & 1, 1)
    out.append(w.scan(bytes([1, 1, 0, 0, 0, 16])))
    for lo, hi in ((1, 9), (10, 63)):
        w = Writer()
        for block in coefficients:
            zeros = 0
            for k in range(lo, hi + 1):
                v = shifted(block[k])
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    w.symbol(0xF0)
                    zeros -= 16
                w.symbol(zeros << 4 | _size(v))
                _extra(w, v)
                zeros = 0
            if zeros:
                w.symbol(0)
        out.append(w.scan(bytes([1, 1, 0, lo, hi, 1])))
    for lo, hi in ((1, 9), (10, 63)):
        w = Writer()
        for block in coefficients:
            fresh = [k for k in range(lo, hi + 1) if abs(int(block[k])) == 1]
            last, zeros, held = max(fresh, default=lo - 1), 0, []
            for k in range(lo, hi + 1):
                v = int(block[k])
                if abs(v) > 1:
                    held.append(abs(v) & 1)
                    continue
                if k > last:
                    continue
                if abs(v) == 1:
                    w.symbol(zeros << 4 | 1)
                    w.put(int(v > 0), 1)
                    [w.put(b, 1) for b in held]
                    zeros, held = 0, []
                else:
                    zeros += 1
                    if zeros == 16:
                        w.symbol(0xF0)
                        [w.put(b, 1) for b in held]
                        zeros, held = 0, []
            if last < hi:
                w.symbol(0)
                [w.put(b, 1) for b in held]
        out.append(w.scan(bytes([1, 1, 0, lo, hi, 16])))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("dense", [0.05, 0.4, 1.0])
def test_general_streams_decode_to_their_coefficients(dense):
    rng = np.random.default_rng(5)
    c = np.where(rng.random((12, 64)) < dense, rng.integers(-40, 41, (12, 64)), 0).astype(np.int16)
    image = jpeg.decode(progressive(c, 4, 3))
    assert (image.components[0].coefficients == c).all()
    assert jpeg.rgb(image).shape == (24, 32, 3)


def test_inverse_transform_is_the_formula():
    rng = np.random.default_rng(6)
    c = rng.integers(-30, 31, 64)
    natural = np.zeros((8, 8))
    natural.ravel()[jpeg.ZIGZAG] = c
    a = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    want = [[sum(a(u) * a(v) * natural[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for x in range(8)] for y in range(8)]
    assert np.allclose((c.astype(np.float32) @ jpeg.BASIS).reshape(8, 8), want, atol=1e-3)
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 378, 5000, 100_000, 1_500_000])
def test_payload_round_trip(size):
    text = "".join(random.Random(size).choice("abc é漢\n") for _ in range(size))
    n, payload = jpeg.payload_of(text)
    assert n == len(text.encode()) and len(payload) % 64 == 0 and len(payload) >= 64
    stream = jpeg.encode_payload(payload)
    image = jpeg.decode(stream)
    assert jpeg.payload_from(image) == payload and jpeg.encode_payload(payload) == stream
    assert jpeg.rgb(image).shape == (image.height, image.width, 3)
    assert jpeg.features(image) == jpeg.features(jpeg.decode(stream))


def test_fast_and_slow_scans_agree(monkeypatch):
    stream = jpeg.encode_payload(jpeg.payload_of("the same either way, ÿ" * 40)[1])
    fast = jpeg.decode(stream)
    build = jpeg.Huffman.__init__

    def without_only(self, counts, symbols):
        build(self, counts, symbols)
        self.only = None

    monkeypatch.setattr(jpeg.Huffman, "__init__", without_only)
    slow = jpeg.decode(stream)
    for a, b in zip(fast.components, slow.components):
        assert (a.coefficients == b.coefficients).all()


def test_digests_and_tensors(spark, docs, texts):
    for r in jpeg.digests(docs).collect():
        n, payload = jpeg.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = spark.createDataFrame([(1, bytearray(jpeg.encode_payload(bytes(64)))), (2, bytearray(b"no picture")), (3, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in jpeg.tensors(media).collect()}
    assert len(got[1]["rgb"]) == got[1]["height"] * got[1]["width"] * 3 and got[2]["error"] and got[3]["error"]


def test_a_header_that_asks_for_too_much_is_an_error(spark):
    import time

    _, payload = jpeg.payload_of("a text")
    stream = jpeg.encode_payload(payload)
    frame = stream.index(b"\xff\xc2")
    hostile = stream[: frame + 5] + b"\xff\xff\xff\xff" + stream[frame + 9 :]
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in jpeg.tensors(spark.createDataFrame([(1, bytearray(stream)), (2, bytearray(hostile)), (3, None)], "doc_id long, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["rgb"] and "limit" in got[2]["error"] and got[2]["rgb"] is None and got[3]["error"]
    assert time.perf_counter() - began < 60


# --- language ---


def plain_phrases(data, sample):
    phrases = i = 0
    while i < len(data):
        k = 1
        while i + k < len(data) and data[i : i + k + 1] in sample:
            k += 1
        i += k
        phrases += 1
    return phrases


@pytest.mark.parametrize("piece", [3, 16, 512])
def test_parse_is_the_plain_one(piece):
    """Of whole texts, whatever the pieces that are stepped side by side."""
    sample = b"the cat sat on the mat and the dog sat on the log " + b"abcabd" * 20
    model = langid.Model.learn({"x": [sample], "y": [b"der hund und die katze"]})
    rng = random.Random(2)
    cases = ["".join(rng.choice("thecatsonmdlgq ") for _ in range(rng.randint(1, 1500))).encode() for _ in range(20)] + [b"", b"abcabd" * 300, b"q" * 700, sample * 20]
    got, _ = langid._parse([c.translate(model.classes) for c in cases], model.tables[0], model.width, piece)
    assert got.tolist() == [plain_phrases(c, sample) for c in cases]


def test_learning_is_bounded_whatever_repeats(spark):
    """One id on ten thousand rows, and ten thousand languages: as much is learned as of few."""
    docs = spark.range(10_000).selectExpr("0L doc_id", "concat('the quick brown fox ', id) text", "'en' lang").union(spark.range(1, 300).selectExpr("id", "concat('der hund und die katze ', id) text", "'de' lang"))
    many = spark.range(1000, 11_000).selectExpr("id", "'x' text", "concat('l', id) lang")
    model = langid.learn(docs.union(many), languages=5)
    assert len(model.languages) == 5 and "de" in model.languages
    one = langid.learn(docs)
    assert one.languages == ["de", "en"] and max(map(len, one.tables)) < 100 * langid.ROWS * 200
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    train = fm.train
    try:
        fm.train = lambda found, marks, buckets: seen.append(len(found)) or train(found, marks, buckets)
        fm.learn(docs, labels)
    finally:
        fm.train = train
    assert seen == [len([i for i in (0, 1, 3) if not held_out(i)])]


def test_documents_in_no_known_language_go_and_null_ones_are_named(spark):
    model = langid.learn(common.documents(spark, MORE))
    german = "die ingen und der hund ist nicht in das haus gegangen und die katze schlief"
    rows = [(1, german, None), (2, german, "xx"), (3, "Ο ήλιος ανατέλλει κάθε πρωί πάνω από τη θάλασσα και φωτίζει τα νησιά", "el"), (4, "今日は天気がとても良いので、公園まで散歩に行きました。", None), (5, "123 --- 456", "en")]
    got = {r["doc_id"]: r["lang"] for r in langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert got == {1: "de", 2: "xx"}


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in common.documents(spark, MORE).select("doc_id", "lang").collect()}
    rows = registry.op8_cross_parsing(spark, MORE).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth[r["doc_id"]]]) > 0.97


# --- SimHash ---


def plain_fingerprint(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(fps)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in fps}


def test_components_are_those_of_all_pairs(docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: r["fp"] % (1 << 64) for d, r in got.items()} == fps
    assert {d: r["component_id"] for d, r in got.items()} == plain_components(fps)


@pytest.mark.parametrize("block", [3, 4096])
def test_dense_groups_in_blocks(spark, block):
    """Clusters of many distinct fingerprints, joined by chains, with keys dealt into small blocks."""
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    labels = {r["node"]: r["component"] for r in simhash.components(simhash.link_forest(rows, block)).collect()}
    want = plain_components({x: x % (1 << 64) for x in sorted(signed)})
    groups = defaultdict(set)
    for x in signed:
        groups[labels.get(x, x)].add(x)
    plain = defaultdict(set)
    for x, r in want.items():
        plain[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_many_probes_of_few_fingerprints(spark):
    """Probes gather under a key with few fingerprints of its own: split parts give the same components."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(150)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = None
    for block in (4096, 16, 3):
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.link_forest(df, block).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in edges)
        parent = {x: x for x in fps}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        got = {x: root(x) for x in fps}
        want = want or {x: min(group) for group in _groups_of(fps) for x in group}
        assert got == want


def _groups_of(fps):
    left, out = set(fps), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        out.append(group)
    return out


def test_dense_groups_cost_a_step_a_row():
    import time

    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(0, 1 << 62))
    near = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    began = time.perf_counter()
    edges = simhash._forest(near, near, 0)
    assert time.perf_counter() - began < 5 and edges


def test_long_chain_converges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(4)
    assert {r["component"] for r in simhash.components(edges).collect()} == {0}


# --- passages ---


def test_every_long_subsequence_lies_in_one_window():
    rng = np.random.default_rng(4)
    for h in (rng.integers(0, 1 << 60, 60).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64), np.zeros(60, np.uint64)):
        windows = passages.compact_windows(h, 5)
        for i in range(60):
            for j in range(i + 4, 60):
                over = [(l, c, r) for l, c, r in windows if l <= i <= c <= j <= r]
                assert len(over) == 1 and h[over[0][1]] == h[i : j + 1].min()
        assert len(windows) <= 2 * 60


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(0, 60, 2):
        passage = words(rng, 51 + i)
        a, b = words(rng, rng.randint(0, 80)), words(rng, rng.randint(0, 80))
        copy = list(passage)
        if i % 4 == 0 and i > 20:
            copy[len(copy) // 2] = "changed"
        rows += [(2 * i, " ".join(a + passage + b)), (2 * i + 1, " ".join(b[:5] + copy + a[:7]))]
        want[2 * i + 1] = (min(5, len(b)), len(passage))
    rows += [(1000 + i, " ".join(words(rng, 200) + ["a", "short", "common", "phrase"] * 5)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in passages.repeats(docs).collect()}
    assert got.keys() == want.keys()
    for d, (first, n) in want.items():
        assert (got[d]["first_id"], got[d]["start_word"], got[d]["n_words"]) == (d - 1, first, n) and got[d]["similarity"] >= 0.8
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs).collect()}
    for d, text in rows:
        gone = want.get(d)
        kept = text.split()
        assert left.get(d, "").split() == (kept[: gone[0]] + kept[gone[0] + gone[1] :] if gone else kept)


def test_exact_repeats_are_all_found(spark):
    docs = common.documents(spark, MORE)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    shingles = passages.Shingler()
    tokens = {d: shingles(t) for d, t in texts.items()}
    runs, want = {}, set()
    for d in sorted(tokens):
        t = tokens[d].tobytes()
        own = {t[i : i + 8 * 46] for i in range(0, len(t) - 8 * 46 + 8, 8)}
        if any(runs.get(x, d) != d for x in own):
            want.add(d)
        for x in own:
            runs.setdefault(x, d)
    got = {r["doc_id"] for r in passages.repeats(docs).collect()}
    assert want <= got and len(got) <= len(want) * 1.1


def every_alike_pair(tokens):
    """(later, earlier) of all pairs of documents with a passage at Jaccard 0.8: no windows, no keys, each pair with enough shingles in common verified."""
    holders = defaultdict(set)
    for d, t in tokens.items():
        for x in set(t.tolist()):
            holders[x].add(d)
    common = Counter()
    for ids in holders.values():
        if len(ids) > 1:
            ids = sorted(ids)
            common.update((b, a) for i, a in enumerate(ids) for b in ids[i + 1 :])
    return {(b, a) for (b, a), n in common.items() if n >= 36 and passages.stretches(tokens[b], tokens[a])}


def test_documents_against_all_pairs(spark):
    docs = common.documents(spark, MORE)
    shingles = passages.Shingler()
    tokens = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    got = {r["doc_id"] for r in passages.repeats(docs).collect()}
    alike = {a for a, _ in every_alike_pair(tokens)}
    assert got <= alike and len(got) >= 0.98 * len(alike)


def edited(rng, passage):
    """One change in some 25 words: substitutions, insertions, deletions."""
    out = list(passage)
    for _ in range(max(1, len(passage) // 60)):
        i = rng.randrange(2, len(out) - 2)
        out[i : i + rng.choice([0, 1, 1])] = words(rng, rng.choice([0, 1, 1, 2]))
    return out


def test_near_copies_against_all_pairs(spark):
    """Edited passages in texts that also share templates, frequent lines and snippets; every document that has a passage of an earlier one is found."""
    rng = random.Random(21)
    lines = [words(rng, rng.choice([8, 20, 30, 45])) for _ in range(12)]
    texts = {}
    for i in range(150):
        passage = words(rng, rng.randint(51, 200))
        texts[i] = words(rng, 60) + rng.choice(lines) + passage + rng.choice(lines) + words(rng, 30)
        at = rng.randrange(len(passage) - 25)
        texts[-1 - i] = words(rng, 60) + passage[at : at + 25] + words(rng, 30) + rng.choice(lines)  # a lesser id that holds a snippet
        for k in range(1, rng.randint(2, 4)):
            texts[1000 * k + i] = words(rng, rng.randint(0, 50)) + rng.choice(lines) + edited(rng, passage) + words(rng, rng.randint(0, 50))
    shingles = passages.Shingler()
    want = {a for a, _ in every_alike_pair({d: shingles(" ".join(t)) for d, t in texts.items()})}
    got = {r["doc_id"] for r in passages.repeats(spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")).collect()}
    assert len(want) > 150 and got <= want and len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("snippets", [0, 6, 12])
def test_earlier_snippets_hide_no_passage(spark, snippets):
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(60):
        passage = words(rng, 60)
        for k in range(snippets):
            at = rng.randrange(40)
            rows.append((100 * i + k, " ".join(words(rng, 50) + passage[at : at + 20] + words(rng, 50))))
        rows += [(10_000 + i, " ".join(words(rng, 30) + passage + words(rng, 40))), (20_000 + i, " ".join(words(rng, 45) + passage + words(rng, 20)))]
        want.add((20_000 + i, 10_000 + i, 45, 60))
    got = {(r["doc_id"], r["first_id"], r["start_word"], r["n_words"]) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_words_are_hashed_as_a_split_gives_them():
    rng = random.Random(0)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "zz", "\x00"]) for _ in range(rng.randint(0, 200))) for _ in range(200)] + [None, "", " ", "x" * 500]
    whole, small, known = passages.Shingler(), passages.Shingler(64), {}
    for text, tokens in zip(texts, whole.column(pa.array(texts)), strict=True):
        raw = (text or "").encode()
        hashes = whole.words(np.frombuffer(raw, np.uint8))
        assert len(hashes) == len(raw.split()) and (hashes == small.words(np.frombuffer(raw, np.uint8))).all() and (tokens == small(text)).all()
        for word, h in zip(raw.lower().split(), hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_one_passage_everywhere(spark):
    """A passage that a third of all documents share: a few pairs a document, never all pairs."""
    rng = random.Random(1)
    passage = words(rng, 70)
    rows = [(i, " ".join(words(rng, 60) + (passage if i % 3 == 0 else []) + words(rng, 60))) for i in range(600)]
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(3, 600, 3)) and {r["n_words"] for r in got} == {70}
    assert sum(r["first_id"] == 0 for r in got) == 199 and len(got) < 3 * 199


def one_stretch(later, earlier):
    shingles = passages.Shingler()
    return [(lo, hi - lo + passages.WORDS, round(s, 3)) for lo, hi, s in passages.stretches(shingles(" ".join(later)), shingles(" ".join(earlier)))]


def test_edits_are_measured_before_a_stretch_is_split():
    rng = random.Random(3)
    p, new = words(rng, 80), words(rng, 8)
    longer = p[:40] + new + p[40:]
    # an insertion in the later copy, and the same in the earlier one
    assert one_stretch(longer, p) == [(0, 88, 0.818)]
    assert one_stretch(p, longer) == [(0, 80, 0.818)]
    # deletions are insertions on the other side; text around changes nothing
    around = words(rng, 50)
    assert one_stretch(around + longer + words(rng, 60), words(rng, 30) + p + words(rng, 20)) == [(50, 88, 0.818)]


def test_like_parts_of_longer_stretches_keep_their_edits():
    rng = random.Random(5)
    p = words(rng, 60)
    edited = p[:30] + ["changed"] + p[31:]
    far = words(rng, 200)
    often = [w if i % 7 else f"x{i}" for i, w in enumerate(far)]  # one word in seven differs: not alike
    got = one_stretch(often + edited, far + p)
    assert [(lo <= 200 and lo + n == 260 and s >= 0.8) for lo, n, s in got] == [True]


@pytest.mark.parametrize("seed", range(6))
def test_stretches_reach_what_brute_force_finds(seed):
    """The longest pair of stretches of the planted edits at Jaccard 0.8 is found, whatever the kind of edit."""
    rng = random.Random(seed)
    p = words(rng, 90)
    copy = list(p)
    for _ in range(rng.randint(1, 3)):
        i, n = rng.randrange(5, len(copy) - 12), rng.randint(1, 6)
        copy[i : i + rng.choice([0, n])] = words(rng, rng.choice([0, n]))
    shingles = passages.Shingler()
    a, b = shingles(" ".join(copy)), shingles(" ".join(p))
    best = 0
    for i in range(len(a)):
        for j in range(i + 45, len(a)):
            mine = set(a[i : j + 1].tolist())
            at = [k for k, x in enumerate(b.tolist()) if x in mine]
            if at and mine >= {a[i], a[j]} and {a[i], a[j]} <= set(b.tolist()):
                theirs = set(b[at[0] : at[-1] + 1].tolist())
                if len(mine & theirs) >= 0.8 * len(mine | theirs):
                    best = max(best, j - i + 1)
    got = max((hi - lo + 1 for lo, hi, _ in passages.stretches(a, b)), default=0)
    assert got >= best - 2 and (got > 0) == (best > 0)


def test_copies_meet_whatever_the_least_document_of_their_keys_is(spark):
    """A frequent line stands alone in lesser documents, and in the middle of passages that two documents each share."""
    rng = random.Random(8)
    line = words(rng, 48)  # too short to be a passage itself
    rows = [(i, " ".join(words(rng, 60) + line + words(rng, 60))) for i in range(10)]
    want = set()
    for i in range(60):
        text = words(rng, 1) + line + words(rng, 1)
        rows += [(1000 + i, " ".join(words(rng, 60) + text + words(rng, 60))), (2000 + i, " ".join(words(rng, 70) + text + words(rng, 60)))]
        want.add((2000 + i, 1000 + i, 70, 50))
    got = {(r["doc_id"], r["first_id"], r["start_word"], r["n_words"]) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and all(g in want for g in got)


def test_short_passages_with_an_edit_in_the_middle_meet(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1000):
        passage = words(rng, 50)
        rows += [(i, " ".join(passage)), (5000 + i, " ".join([*passage[:25], f"edit{i}", *passage[26:]]))]
    got = {(r["doc_id"], r["first_id"]) for r in passages.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({(5000 + i, i) for i in range(1000)} & got) >= 995


# --- the pipeline ---


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    out = registry.pipeline(spark, SMALL)
    docs = common.documents(spark, SMALL)
    one = simhash.one_of_each(langid.identified(docs, langid.learn(docs)))
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(one).collect()}
    encoder = packing.Encoder(*packing.vocabulary())
    tokens = {d: len(encoder.ids(t)) + 1 for d, t in left.items()}
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += r["length"]
    assert got == tokens
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing sources", "packing"]


def test_language_and_mixing_change_the_result(spark, monkeypatch):
    import corpus_pipeline

    def outcome():
        return {(r["doc_id"], r["start"]): r["sequence_id"] for r in registry.pipeline(spark, SMALL).select("doc_id", "start", "sequence_id").collect()}

    real = common.documents
    greek = [(10**6 + i, "Ο ήλιος ανατέλλει κάθε πρωί πάνω από τη θάλασσα και φωτίζει τα νησιά " * 2 + f"λέξη{i} " * 9, None, "src0", 0) for i in range(5)]
    with_greek = lambda spark, sf_dir, name="documents": real(spark, sf_dir, name).union(spark.createDataFrame(greek, "doc_id long, text string, lang string, source string, n_chars long"))
    monkeypatch.setattr(corpus_pipeline, "documents", with_greek)
    whole = outcome()
    assert not any(d >= 10**6 for d, _ in whole)
    stages = dict(corpus_pipeline.STAGES)
    for off in ("language ID", "mixing sources"):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, (lambda spark, docs, sf_dir: docs) if n == off else f) for n, f in stages.items()])
        other = outcome()
        assert other != whole
        assert any(d >= 10**6 for d, _ in other) == (off == "language ID")


def test_pipeline_numbers_sequences_along_the_mix(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "a b c d e f g h", f"src{i % 3}") for i in range(960)], "doc_id long, text string, source string")
    corpus_pipeline.mixed(spark, docs, "/nowhere").write.parquet(str(tmp_path / "mix"))
    got = corpus_pipeline.packed(spark, spark.read.parquet(str(tmp_path / "mix")), "/nowhere").collect()
    place = {r["doc_id"]: (r["slot"], r["position"]) for r in mixing.mix(docs, registry.WEIGHTS, registry.REST).collect()}
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["sequence_id"]):
        by[r["length"]].append(r["doc_id"])
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    for ids in by.values():
        assert ids == sorted(ids, key=place.get)
        # src0, src1, src2 are wanted as 0.1 : 0.15 : 0.1, until one runs out; a block holds 16 documents
        for n in range(16, 700, 16):
            assert abs(sum(d % 3 == 1 for d in ids[:n]) - n * 0.15 / 0.35) <= 17


def test_pipeline_ends_with_token_ids(spark):
    got = registry.pipeline(spark, SMALL).select("length", "ids_crc32", "ids").collect()
    assert got
    for r in got:
        assert len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
