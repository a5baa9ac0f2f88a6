"""Every operator and stage over odd tables: no crash, and the results that the docstrings define."""

import pytest

import corpus_pipeline
from quillstone.llm import fm, jpeg, langid, licenses, mixing, packing, passages, simhash, spotsigs, urls

MODEL = langid.Model.learn({"en": [langid.folded("the quick brown fox and the dog of the house " * 20)], "de": [langid.folded("der hund und die katze auf der strasse mit dem mann " * 20)]})
_EXAMPLES = ["the quick brown fox jumps over the dog", "click here!!! buy now | cheap", "a house and a small cat", "!!! win | win | win 777"] * 8
MACHINE = fm.train([fm.Features(64).of(x) for x in _EXAMPLES], fm.np.array([1, 0, 1, 0] * 8, fm.np.float32), 64)

RUNS = {
    "mix": lambda d: mixing.mix(d),
    "in_order": lambda d: mixing.in_order(d),
    "quality": lambda d: fm.score(d, MACHINE),
    "pack": lambda d: packing.pack(d, with_ids=False),
    "edited": spotsigs.compare_edited,
    "licenses": licenses.scan,
    "jpeg": jpeg.digests,
    "language": lambda d: langid.identify(d, MODEL),
    "simhash": simhash.near_duplicates,
    "one_of_each": simhash.one_of_each,
    "passages": passages.repeats,
    "without": passages.without_repeats,
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(name, no_docs):
    assert RUNS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns_change_nothing(name, odd_docs, clashing):
    plain, more = RUNS[name](odd_docs), RUNS[name](clashing)
    if name in ("in_order", "one_of_each", "without"):
        assert more.columns == clashing.columns
        more = more.toDF(*[f"c{i}" for i in range(len(more.columns))]).select("c0", "c1", "c2", "c3", "c4")
    assert rows(plain) == rows(more)


def test_defined_cases(odd_docs):
    n = odd_docs.count()
    by = {r["doc_id"]: r for r in licenses.scan(odd_docs).collect()}
    assert by[2]["n_words"] == 0 and by[2]["first_word"] is None and by[2]["labels"] == "" and by[2]["score"] == 0
    found = {r["doc_id"]: r for r in langid.identify(odd_docs, MODEL).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "und", "und", "und", "de"]
    comps = {r["doc_id"]: r for r in simhash.near_duplicates(odd_docs).collect()}
    assert comps[1]["component_id"] == comps[9]["component_id"] == 1
    assert comps[2]["fp"] == comps[3]["fp"] == 0 and comps[3]["component_id"] == 2
    kept = [r["doc_id"] for r in simhash.one_of_each(odd_docs).collect()]
    assert kept.count(1) == 1 and 9 not in kept and 3 not in kept and None in kept
    assert {r["doc_id"] for r in jpeg.digests(odd_docs).where("payload_bytes = 64 and n_bytes = 0").collect()} == {2, 3}
    mixed = mixing.mix(odd_docs).collect()
    assert len(mixed) == n and len({(r["slot"], r["position"]) for r in mixed}) == n
    assert mixing.in_order(odd_docs).count() == n
    assert langid.identified(odd_docs, MODEL).where("doc_id in (2, 3, 4)").count() == 0
    edited = spotsigs.compare_edited(odd_docs).collect()
    assert len(edited) == n and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in edited)


def test_quality_of_odd_rows_differs(odd_docs):
    got = fm.score(odd_docs, MACHINE).collect()
    assert len(got) == odd_docs.count() and len({r["score"] for r in got}) > 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_learning_over_clashing_columns_and_repeated_rows(odd_docs, clashing, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 1, 3, 5, 6, 8, 9)], "doc_id long, quality int, toxic int")
    assert rows(fm.score(odd_docs, fm.learn(odd_docs, labels))) == rows(fm.score(odd_docs, fm.learn(clashing, labels)))
    assert rows(langid.identify(odd_docs, langid.learn(odd_docs))) == rows(langid.identify(odd_docs, langid.learn(clashing)))
    pairs = [rows(spotsigs.similar_pairs(d)[0]) if isinstance(spotsigs.similar_pairs(d), tuple) else rows(spotsigs.similar_pairs(d)) for d in (odd_docs, clashing)]
    assert pairs[0] == pairs[1]


def test_learning_without_labels(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scores = fm.score(odd_docs, fm.learn(odd_docs, labels)).collect()
    assert {r["score"] for r in scores} == {0.5}
    nothing = langid.identify(odd_docs, langid.learn(no_docs)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_pages(spark):
    schema = "page_id long, url string, html string, PAGE_ID string, host string, rule string"
    pages = spark.createDataFrame(
        [(1, None, None, "z", "z", "z"), (2, "no scheme", "<a href=//x.org/>", "z", "z", "z"), (None, "http://A.com/en/1?x", None, "z", "z", "z"), (4, "http://b.net/de/9", None, "z", "z", "z"), (4, "http://b.net/de/9", None, "z", "z", "z"), (5, "x://example.net/de/8#y", "", "z", "z", "z")],
        schema,
    )
    got = rows(urls.judge_pages(pages, urls.RULES))
    assert got == sorted(
        [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "a.com", "/en/1", "com/en/", "block"), (4, "b.net", "/de/9", "net/de/", "allow"), (4, "b.net", "/de/9", "net/de/", "allow"), (5, "example.net", "/de/8", "example.net/de/8", "block")],
        key=repr,
    )
    assert urls.judge_pages(pages.limit(0), urls.RULES).collect() == []


def test_stages_over_odd_rows(spark, odd_docs, tmp_path):
    docs = odd_docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/nowhere")
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() > 0


def test_stages_over_no_rows(spark, no_docs, tmp_path):
    docs = no_docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/nowhere").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == 0
