"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a bounded sample of its
labelled text. A text is cross-parsed against each: from left to right, the longest
stretch that occurs in the sample is one phrase, then the next begins. The language
that needs the fewest phrases, normalised as cross-entropy (phrases times log2 of the sample's
length, per byte of text), wins; ties go to the language first by name.

The automaton with its restarts is a finite transducer (state, byte class) -> (state,
phrase ended), stored as one table per language. numpy steps through many pieces of
text at once. A text is cut into pieces of ``PIECE`` classes, which are parsed side by side,
so that a very long text takes as many steps as a short one. Then every piece is parsed on into
the next one until both parses are in the same state, from where they are one, and the phrases
before that place are counted anew: the result is that of the parse of the whole text.

Learning: the ``LANGUAGES`` languages with the most labelled rows (ties by name), at most ``ROWS`` ids of
each (those of a length in ``LENGTHS`` first, then by a hash of the id), one row an id, of each at
most the upper length, in all about ``SAMPLE`` classes a language. So the sample and the model are bounded
at any size of the corpus, whatever ids or languages repeat. These bounds are the
sample's; predictions read whole texts.

The filter drops texts that are in none of the languages: without a letter, or, from ``TELLING`` bytes on,
with no fewer bits a byte in the best language than the ``PLAIN`` 8 that the text has without any
parsing. Where lang is null, it becomes the predicted one.

Defined cases: null or empty text, and text without a letter, gives ``und`` and score 0. Without
any labelled row every text is ``und``; the filter then only drops texts without a letter. Ties of languages go to
the first by name. Empty tables give no rows. Repeated rows get equal values. Extra columns,
whatever their names, are ignored, and kept by the filter; lang, source and doc_id are never inputs of a
prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, held_out, learnable, take

UNKNOWN = "und"
PIECE = 512
ROWS = 64
SAMPLE = 24_000
LANGUAGES = 50
LENGTHS = (200, 6000)
PLAIN = 8.0
TELLING = 20


def _folding() -> bytes:
    """Byte to byte: A-Z lower-cased, ASCII that is no letter becomes a space, other bytes stay."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


FOLD = _folding()


def folded(text: str) -> bytes:
    """Lower-cased UTF-8 whose runs of ASCII non-letters are single spaces.

    Upper-case letters of two bytes are folded too (their second byte, after 0xC3).
    """
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of data; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for ch in data:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Model:
    languages: list[str]
    classes: bytes  #: byte to class; class 0 occurs in no sample
    width: int
    tables: list[np.ndarray]  #: (state * width + class) -> 4 * (next state * width) + phrases ended
    cost: list[float]  #: bits that name one phrase: log2 of the sample's length

    @staticmethod
    def learn(samples: dict[str, list[bytes]]) -> Model:
        samples = {k: [x for x in v if x] for k, v in sorted(samples.items())}
        samples = {k: v for k, v in samples.items() if v}
        seen = sorted({b for v in samples.values() for x in v for b in x})
        of = np.zeros(256, np.uint8)
        for i, b in enumerate(seen, 1):
            of[b] = i
        classes, width = of.tobytes(), len(seen) + 1
        coded = [b" ".join(rows).translate(classes) for rows in samples.values()]
        return Model(list(samples), classes, width, [_table(x, width) for x in coded], [float(np.log2(len(x) + 1)) for x in coded])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is 1 - (the winner's entropy / the runner-up's)."""
        return [(language, score) for language, score, _ in self.measured(texts)]

    def measured(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether the text is in that language at all) of each text."""
        known = [i for i, x in enumerate(texts) if self.languages and has_letter(x)]
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        coded = [folded(texts[i]).translate(self.classes) for i in known]
        if not coded:
            return out
        needs = []
        for table, cost in zip(self.tables, self.cost, strict=True):
            phrases, total = _parse(coded, table, self.width)
            needs.append(phrases * cost / np.maximum(total, 1))
        needs = np.array(needs)
        best = needs.argmin(axis=0)
        ranked = np.sort(needs, axis=0)
        second = ranked[1] if len(ranked) > 1 else ranked[0] * 2
        score = np.where(second > 0, 1 - ranked[0] / np.where(second > 0, second, 1), 0.0)
        told = (ranked[0] < PLAIN) | (np.array([len(x) for x in coded]) < TELLING)
        for i, b, s, t in zip(known, best.tolist(), np.clip(score, 0, 1).tolist(), told.tolist(), strict=True):
            out[i] = (self.languages[b], s, t)
        return out


def _table(coded: bytes, width: int) -> np.ndarray:
    states = suffix_automaton(coded)
    root = np.zeros(width, np.int64)
    for ch, to in states[0].items():
        root[ch] = to * width
    table = np.empty((len(states), width), np.int64)
    # no way on: the phrase ends before this class, which begins the next or, in no sample, is one of its own
    table[:] = root * 4 + np.where(root > 0, 1, 2)
    for state, ways in enumerate(states):
        for ch, to in ways.items():
            table[state, ch] = to * width * 4
    table[0, root == 0] = 1
    return table.ravel().astype(np.int32)


def _parse(coded: list[bytes], table: np.ndarray, width: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, classes) of each text; pieces of all texts are stepped side by side."""
    lengths = np.array([len(x) for x in coded], np.int64)
    counts = -(-lengths // piece)
    phrases = np.zeros(len(coded), np.int64)
    owner = np.repeat(np.arange(len(coded)), counts)
    if not len(owner):
        return phrases, lengths
    padded = np.zeros((len(owner), piece), np.uint8)
    flat = padded.ravel()
    at = 0
    for text, n in zip(coded, counts.tolist(), strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * piece
    sizes = np.full(len(owner), piece, np.int64)
    ends = np.cumsum(counts)[counts > 0] - 1
    sizes[ends] = lengths[counts > 0] - (counts[counts > 0] - 1) * piece
    order = np.argsort(-sizes, kind="stable")
    columns = np.ascontiguousarray(padded[order].T)
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(piece), side="left")  # pieces longer than each step
    state = np.zeros(len(owner), np.int32)
    ended = np.zeros(len(owner), np.int32)
    states, counts_at = (np.zeros((piece, len(owner)), np.int32) for _ in range(2))
    for step in range(piece):
        n = int(active[step])
        if not n:
            break
        got = table.take(state[:n] + columns[step, :n])
        ended[:n] += got & 3
        np.right_shift(got, 2, out=state[:n])
        states[step, :n], counts_at[step, :n] = state[:n], ended[:n]
    final = np.zeros(len(owner), bool)
    final[ends] = True
    final = final[order]
    closing = state != 0  # the phrase that the text's end closes
    np.add.at(phrases, owner[order], ended + (closing & final))
    # every piece but a text's last is parsed on into the next one, until both parses are in one state
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    seams = np.flatnonzero(~np.isin(np.arange(len(owner)), ends))
    here, on = state[at[seams]], at[seams + 1]
    more = np.zeros(len(seams), np.int64)
    whole = set()
    for step in range(piece):
        over = sizes[on] <= step  # the next piece ended and the parses never met
        for i in np.flatnonzero(over).tolist():
            if final[on[i]]:
                last = int(sizes[on[i]]) - 1
                phrases[owner[seams[i]]] += more[i] + (here[i] != 0) - counts_at[last, on[i]] - closing[on[i]]
            else:
                whole.add(int(owner[seams[i]]))
        seams, here, on, more = seams[~over], here[~over], on[~over], more[~over]
        if not len(seams):
            break
        got = table.take(here + columns[step, on])
        more += got & 3
        here = got >> 2
        met = here == states[step, on]
        np.add.at(phrases, owner[seams[met]], more[met] - counts_at[step, on[met]])
        seams, here, on, more = seams[~met], here[~met], on[~met], more[~met]
    for i in range(len(seams)):
        if final[on[i]]:
            phrases[owner[seams[i]]] += more[i] + (here[i] != 0) - counts_at[piece - 1, on[i]] - closing[on[i]]
        else:
            whole.add(int(owner[seams[i]]))
    for text in whole:  # a piece's parse that never met the one before it: rare, so the text is parsed in one go
        now, n = 0, 0
        for c in coded[text]:
            got = int(table[now + c])
            n, now = n + (got & 3), got >> 2
        phrases[text] = n + (now != 0)
    return phrases, lengths


def learn(docs: DataFrame, rows: int = ROWS, sample: int = SAMPLE, lengths: tuple[int, int] = LENGTHS, languages: int = LANGUAGES) -> Model:
    """The model from labelled rows that may be learned from; a bounded sample goes to the driver."""
    labelled = take(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = labelled.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull())
    ids = F.approx_count_distinct("doc_id").alias("ids")
    most = {r["lang"]: r["ids"] for r in usable.groupBy("lang").agg(ids).orderBy(F.col("ids").desc(), "lang").limit(languages).collect()}
    # of each language the ids with the least hashes, some 50 times as many as are wanted, so that neither the ranking nor one id's many rows move much
    span = {lang: min(1 << 63, -(1 << 63) + (1 << 64) * 50 * rows // max(1, n)) for lang, n in most.items()}
    below = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(h, (1 << 63) - 1))) for lang, h in span.items()], F.lit(-(1 << 63)))
    usable = usable.withColumn("h", F.xxhash64("doc_id")).where(F.col("text").isNotNull() & F.col("lang").isin(list(most)) & (F.col("h") <= below))
    odd = ~F.length("text").between(*lengths)
    rank = Window.partitionBy("lang").orderBy("odd", "h", "doc_id")
    chosen = usable.groupBy("lang", "h", "doc_id").agg(F.min(odd).alias("odd")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= rows)
    # one row an id: the least of its texts, those of a wanted length first
    start = F.struct(odd, F.substring("text", 1, lengths[1]).alias("text"))
    picked = usable.join(F.broadcast(chosen.select("doc_id", "lang", "r")), ["doc_id", "lang"]).groupBy("lang", "r").agg(F.min(start).alias("t")).select("lang", "r", "t.text")
    samples: dict[str, list[bytes]] = {}
    total: dict[str, int] = {}
    for row in sorted(picked.collect(), key=lambda x: (x["lang"], x["r"])):
        data = folded(row["text"])
        if total.get(row["lang"], 0) < sample:
            samples.setdefault(row["lang"], []).append(data)
            total[row["lang"]] = total.get(row["lang"], 0) + len(data)
    return Model.learn(samples)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = model.predict(part.column(batch.num_columns - 1).to_pylist())
                arrays = [part.column(i) for i in range(batch.num_columns - 1)]
                arrays += [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(shared, text_at: int, lang_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(text_at).to_pylist()
                found = model.measured(texts)
                arrays = list(part.columns)
                if lang_at is not None and model.languages and part.column(lang_at).null_count:
                    told = [old if old is not None else new for old, (new, _, _) in zip(part.column(lang_at).to_pylist(), found, strict=True)]
                    arrays[lang_at] = pa.array(told, part.column(lang_at).type)
                known = [t for _, _, t in found] if model.languages else [has_letter(x) for x in texts]
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array(known, pa.bool_()))

    return run


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that are in a known language; where lang is null it becomes the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = Rows(docs)
    named = whole.at("lang") if whole.has("lang") and dict(docs.dtypes)["lang"] == "string" else None
    return whole.back(whole.rows.mapInArrow(_keep(shared, whole.at("text"), named), whole.rows.schema))
