"""Operators against hand-computed cases and plain restatements, on inline fixtures."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.functions import ocr as O
from quillstone.functions import text as T
from quillstone.operators import chunks, graph, rerank, screener, search, tables, trees
from quillstone.sources import detect, files, stores

INSURANCE = [
    (1, "The premium is ₹ 5,000 or Rs. 10 lakh. See as per clause 2.1 for room rent."),
    (2, "Note: cataract is not covered.\n\nINR 300.50 applies, however a copay of 20% holds."),
    (3, "plain words only"),
    (4, "1\\. first\na) second\n2.1 Scope of cover\n- item"),
]


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def insurance(spark):
    return spark.createDataFrame(INSURANCE, "doc_id long, text string")


def test_features(insurance):
    t = F.col("text")
    got = {r["doc_id"]: r for r in insurance.select("doc_id", T.re_count(t, T.MONEY).alias("m"), T.re_count(t, T.POLICY_TERMS).alias("p"), T.re_count(t, T.NOTES).alias("n"), T.re_count(t, T.LISTS).alias("l"), T.importance(t).alias("i")).collect()}
    assert got[1]["m"] == 3 and got[1]["p"] == 2 and got[2]["n"] == 1 and got[4]["l"] == 4
    assert got[3]["i"] == pytest.approx(1 * (1 + 16 / 1000 * 0.2))
    e = {r["doc_id"]: r["e"] for r in insurance.select("doc_id", T.entities(t).alias("e")).collect()}
    assert e[2]["percentage"] == ["20%"] and e[1]["sum_insured"] == ["Rs. 10 lakh", "₹ 5,000"] and e[3] == {}


@pytest.mark.parametrize("q,kind", [("What is the maximum?", "monetary"), ("Are insurers liable", "monetary"), ("unless he is", "condition"), ("who can apply", "coverage"), ("hello", "general")])
def test_question_types(spark, q, kind):
    assert one(spark, T.question_type(F.col("t")), q) == kind


@pytest.mark.parametrize("url,ok", [("http://a.example.org/x", True), ("https://10.0.0.1/", False), ("ftp://a.example.org", False), ("http://a", False), (None, False), ("http://localhost:8080/abc", False)])
def test_urls(spark, url, ok):
    assert one(spark, T.url_ok(F.col("t")), url) is ok


def test_text_functions(spark):
    assert one(spark, T.sanitize(F.col("t")), "  <b>x</b> & <script>bad()</script> javascript:go \x01 onload = y ") == "x &amp; go y"
    assert one(spark, T.as_question(F.col("t")), "what now") == "what now?"
    assert one(spark, T.as_question(F.col("t")), "x") is None
    assert one(spark, T.line_clean(F.col("t")), "  a   b \n\n\t\n c ") == "a b\nc"
    assert one(spark, T.sha16(F.col("t")), "") == "empty_doc"
    assert one(spark, T.short_title(F.col("t")), "x" * 60) == "x" * 47 + "..."
    assert one(spark, T.node_id(F.col("t")), "a-long name.with parts") == "a_long_n_" + "_parts"
    assert one(spark, T.expanded_queries(F.col("t"), F.lit("q")), '1. "what is the limit of it"\n- short\n* another longer one') == ["what is the limit of it", "another longer one"]
    assert one(spark, T.unfenced_json(F.col("t"), "a int")["a"], '```json\n{"a": 3}\n```') == 3
    table = F.array(F.array(F.lit("h|1"), F.lit("h2")), F.array(F.lit("a")))
    assert one(spark, T.markdown_table(table, escape=True), "") == "| h\\|1 | h2 |\n| --- | --- |\n| a |  |"
    assert [one(spark, T.is_row_label(F.col("t")), x) for x in ("iv.", "(a)", "12)", "hello", "1234")] == [True, True, True, False, False]
    assert one(spark, T.pdf_garbage(F.col("t"), strict=True), "a << b") and not one(spark, T.pdf_garbage(F.col("t")), "a << b")


def plain_k(s):
    if len(s) <= 1:
        return 4
    drops = [1.0 if a <= 0 else (a - b) / a for a, b in zip(s, s[1:])]
    limit = 0.08 if s[0] > 0.8 else 0.1
    found = []
    found += [i + 2 for i, d in enumerate(drops) if i + 2 >= 4 and d >= limit][:1]
    found += [i + 1 for i in range(3, len(s)) if s[i] < s[0] * (0.75 if s[0] > 0.8 else 0.7)][:1]
    total = 0
    for i, d in enumerate(drops):
        total += d
        if i + 2 >= 4 and total > 0.25:
            found.append(i + 2)
            break
    mean = sum(drops) / len(drops)
    k = min(found) if found else min(len(s), 12) if mean < 0.03 else 8 if mean < 0.06 else 6
    return max(4, min(k, 15, len(s)))


def test_dynamic_k(spark):
    rng = random.Random(1)
    lists = [[0.9], [0.5, 0.4], [0.0] * 6, [0.9] * 15, [0.9, 0.88, 0.86, 0.2, 0.1]]
    lists += [sorted((rng.random() ** rng.choice([0.1, 1, 3]) for _ in range(rng.randint(1, 15))), reverse=True) for _ in range(150)]
    rows = [(q, i + 1, float(s)) for q, x in enumerate(lists) for i, s in enumerate(x)]
    got = {r["qid"]: r["k"] for r in search.dynamic_k(spark.createDataFrame(rows, "qid long, rank long, score double")).collect()}
    assert got == {q: plain_k(x) for q, x in enumerate(lists)}


def test_relevance_without_hits(spark):
    ranked = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.3)], "qid long, rank long, score double")
    got = {r["qid"]: r["relevant"] for r in search.relevance_gate(ranked, spark.createDataFrame([(1,), (2,), (3,)], "qid long")).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_rerank_quota_and_short_lists(spark):
    rows = [(1, i, "what is the premium limit", f"premium limit {i} is {i} %", t, "t1", "p1", False) for i, t in enumerate(["text"] * 4 + ["footnote"] * 3 + ["table_cell"] * 3)]
    rows += [(2, i, "q", "c", "text", None, None, None) for i in range(2)]
    schema = "qid long, ord long, question string, content string, element_type string, table_id string, parent_id string, has_money boolean"
    got = rerank.reranked(spark.createDataFrame(rows, schema), 5).collect()
    first = sorted((r for r in got if r["qid"] == 1), key=lambda r: r["place"])
    assert [r["et"] for r in first][:3] == ["footnote", "footnote", "table_cell"] and len(first) == 5
    assert [r["ord"] for r in sorted((r for r in got if r["qid"] == 2), key=lambda r: r["place"])] == [0, 1]


TEXT = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(30)) + "." for i in range(40))


@pytest.mark.parametrize("make", [chunks.token_windows(40, 5), chunks.recursive(300, 60), chunks.sections(), chunks.fallback_chars(400, 50), chunks.token_budget(50)])
def test_chunks_cover_the_text(make):
    pieces = make()(TEXT)
    assert len(pieces) > 1 and [n for n, _, _ in pieces] == list(range(len(pieces)))
    assert set(TEXT.split()) <= set(" ".join(c for _, _, c in pieces).split())
    assert make()("short") and not make()("   ")


def test_token_windows_repeat_the_tail():
    pieces = chunks.token_windows(10, 3)()(" ".join(f"w{i}" for i in range(24)))
    assert [len(c.split()) for _, _, c in pieces] == [10, 10, 10, 3]


def test_slides():
    text = "a" * 1150 + " " + "b" * 400
    assert [(s, len(c)) for _, s, c in chunks.slides()()(text)] == [(0, 1150), (1151, 400)]
    early = "a" * 300 + "\n" + "b" * 1500
    assert [s for _, s, _ in chunks.slides(gaps=True)()(early)] == [0, 1100]
    # by default no text is lost
    assert [(s, len(c)) for _, s, c in chunks.slides()()(early)] == [(0, 300), (301, 1200), (1501, 300)]
    rng = random.Random(4)
    for _ in range(20):
        text = "".join(rng.choice(["a", "bc ", ". ", "\n", "d" * rng.randint(1, 60)]) for _ in range(rng.randint(1, 400)))
        covered = set()
        for _, s, c in chunks.slides(120, 10)()(text):
            covered |= set(range(s, s + len(text[s:]) - len(text[s:].lstrip()) + len(c)))
        assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_sections_and_headers(spark):
    made = chunks.sections()()("intro text\nGENERAL TERMS\nbody one\nSECOND PART\nbody two")
    assert [c.splitlines()[0] for _, _, c in made] == ["Introduction", "GENERAL TERMS", "SECOND PART"]
    doc = spark.createDataFrame([(1, "top\n# A\nx\n## B\ny\n# C\nz")], "doc_id long, text string")
    got = {r["section"]: r for r in chunks.headers(doc).collect()}
    assert got[0]["content"] == "top" and (got[2]["h1"], got[2]["h2"]) == ("A", "B") and (got[3]["h1"], got[3]["h2"]) == ("C", None)


HTML = """<table><tr><th>Cover</th><th>Silver Plan</th><th>Gold</th></tr>
<tr><td rowspan="2">Room</td><td>100</td><td>200</td></tr><tr><td>per day</td><td>&nbsp;</td></tr></table>
<!-- PageBreak -->
<table><tr><td>i.</td><td>5</td><td>6</td></tr><tr><td colspan="3">All plans</td></tr></table> text
<table><tr><th>Other</th></tr><tr><td>1</td></tr></table>
| name | b |
|---|---|
| 1 | 2 |
"""


def test_tables(spark):
    got = tables.stitch(HTML)
    assert [g.headers for g in got] == [["Cover", "Silver Plan", "Gold"], ["Other"], ["name", "b"]]
    assert got[0].rows == [["Room", "100 per day", "200"], ["i.", "5", "6"]] and got[0].title == "All plans"
    assert tables.grid(tables.cells("<tr><td rowspan=2 colspan=2>x</td><td>1</td></tr><tr><td>2</td></tr>")) == [["x", "x", "1"], ["x", "2", ""]]  # only the first column of a spanning cell goes on below
    assert tables.headers_alike("Sum Insured", "insured amount") and not tables.headers_alike("age", "city")
    rows = tables.stitched(spark.createDataFrame([(1, HTML), (2, None)], "doc_id long, text string"))
    assert rows.count() == 3
    data = {(r["table_no"], r["row_no"]): r for r in tables.row_chunks(rows).collect()}
    assert data[0, 0]["column_data"] == {"Cover": "Room", "Silver Plan": "100 per day", "Gold": "200"} and data[0, -1]["element_type"] == "complete_table"
    assert "Silver Plan: 100 per day" in data[0, -1]["content"]


def test_pages_that_break_inside_a_row():
    page = "<table><tr><th>Benefit</th><th>Silver</th><th>Gold</th></tr><tr><td>Room</td><td>up to</td><td>up to</td></tr></table><!-- PageBreak --><table><tr><td></td><td>100</td><td>200</td></tr><tr><td>Care</td><td>5</td><td>6</td></tr></table>"
    assert [g.rows for g in tables.stitch(page)] == [[["Room", "up to 100", "up to 200"], ["Care", "5", "6"]]]
    assert tables.description_column(["No", "2024", "Benefit head"]) == 2 and tables.description_column(["No", "12", "Name"]) == 2 and tables.description_column(["No"]) is None
    assert tables.plan_columns(["x", "Silver A", "Gold", "silver b"]) == {"SILVER": 3, "GOLD": 2}
    assert tables.plan_columns(["No", "Benefit", "Year 1", ""]) == {"YEAR 1": 2, "COLUMN 4": 3}


def test_scanned_tables_have_places_of_their_own():
    from quillstone.functions import ocr

    same = "<table><tr><td>1</td></tr></table>"
    text = f"a {same} b {same} | x | y |\n<tr><td>z</td></tr> end"
    found, rest = ocr.take_tables(text)
    assert [text[t["start_pos"] : t["end_pos"]] == t["text"] for t in found] == [True] * 4 and len({t["start_pos"] for t in found}) == 4
    for t in found:
        rest = rest.replace(f"\n\n[TABLE_{t['id']}_PLACEHOLDER]\n\n", t["text"])
    assert rest == text


def test_bpe_windows_are_the_librarys_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding, spans = chunks.bpe_encoding(), chunks.bpe_spans()()
    for text in ("The quick brown fox, it's 12.50 now.", "naïve café 漢字 🙂 end", "", "a" + " " * 50 + "b"):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert chunks.bpe_ids(encoding, text) == ids and len(spans(text)) == len(ids)
        assert "".join(text[a:b] for a, b in spans(text)) == text
    text = " ".join(f"word{i}" for i in range(500))
    pieces = chunks.token_windows(100, 20, make_spans=chunks.bpe_spans())()(text)
    assert len(pieces) > 5 and all(text[s : s + len(c)] == c and c.split()[0].startswith("word") for _, s, c in pieces)
    assert {w for _, _, c in pieces for w in c.split()} == set(text.split())


PARAMS = {"Market Capitalization": "cap", "Price to earning": "pe", "Sales": "sales", "Sales growth": "growth"}


@pytest.mark.parametrize(
    "query,ids",
    [
        ("Market Capitalization > 500 AND Price to earning < 15", [1]),
        ("Sales growth >= 10 OR Sales = 3", [2, 3]),
        ("(Sales + 2) * 10 > Market Capitalization", [2, 3]),
        ("Sales / Price to earning > 0", [1, 3]),
        ("(Sales > 1 AND Sales < 4) OR Market Capitalization >= 1000", [1, 3]),
        ("-Sales + 5 <= 0", [2]),
    ],
)
def test_screens(spark, query, ids):
    rows = spark.createDataFrame([(1, 1000.0, 10.0, 1.0, 5.0), (2, 60.0, 0.0, 5.0, 20.0), (3, 20.0, 40.0, 3.0, 1.0)], "id long, cap double, pe double, sales double, growth double")
    assert [r["id"] for r in screener.screen(rows, query, PARAMS, ["id"]).collect()] == ids


@pytest.mark.parametrize("query", ["Unknown thing > 3", "Sales >", "(Sales > 3", "Sales > 3 3"])
def test_bad_screens(query):
    with pytest.raises((screener.PredicateError, IndexError)):
        screener.parse(query, PARAMS)


def test_graph_operators(spark):
    words = spark.createDataFrame([("claim",), ("claim settlement",), ("premium",), ("reclaim",), ("x",)], "w string")
    assert {r["w"] for r in graph.prune_containing(words).collect()} == {"claim", "premium", "x"}
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 2), (4, 9)], "id long, tokens long")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert {r["id"] for r in graph.drop_near_copies(pairs, sizes).collect()} == {2, 3}
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (4, 5, 1.0), (5, 4, 1.0)], "a long, b long, weight double")
    seeds = spark.createDataFrame([(1, 0, 1.0), (4, 1, 1.0)], "node long, label int, u double")
    assert {r["node"]: r["label"] for r in graph.strongest(graph.propagate_labels(edges, seeds)).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_trees(spark):
    flow = '{"start_node":"a","nodes":[{"node_id":"a","type":"condition","branches":[{"condition":"x>1","label":"yes","next_node":"b"},{"condition":"no","next_node":"gone"}]},{"node_id":"b","type":"process","next_nodes":["a"]}]}'
    got = {tuple(r) for r in trees.flow_edges(spark.createDataFrame([("f", flow)], "flow_id string, json string")).collect()}
    assert got == {("f", "a", "b", "yes"), ("f", "b", "a", None)}


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", content)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = _zip(word__document=f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
PPTX = _zip(ppt__slides__slide1='<p:sld xmlns:p="http://p" xmlns:a="http://a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>Head</a:t></a:p></p:sp><p:sp><a:p><a:t>Body</a:t></a:p></p:sp></p:sld>')
XLSX = _zip(xl__sharedStrings="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2"/></row></sheetData></worksheet>')
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\n" + zlib.compress(b"BT (Page one) Tj T* [(se) -20 (cond)] TJ ET") + b"\nendstream\nendobj"
EML = b"From: a@example.org\r\nSubject: Hi\r\nContent-Type: text/plain\r\n\r\nthe body\r\n"


def test_files(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.pptx": PPTX, "c.xlsx": XLSX, "d.pdf": PDF, "sub/e.eml": EML, "f.txt": b" text ", "g.png": b"\x89PNG\r\n\x1a\n", "h.docx": b"broken", "i.bin": PDF}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    scanned = files.scan(spark, str(tmp_path))
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in scanned.collect()}
    assert kinds["i.bin"] == "pdf" and kinds["a.docx"] == "docx" and kinds["g.png"] == "image" and kinds["e.eml"] == "eml"
    got = {}
    for r in files.pages(scanned).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["number"], r["part"], r["content"]))
    assert got["a.docx"] == [(1, "paragraph", "Hello"), (2, "table", "a | b")]
    assert got["b.pptx"] == [(1, "title", "Head"), (1, "text", "Body")]
    assert got["c.xlsx"] == [(1, "sheet", "| name |  | 2 |\n| --- | --- | --- |")]
    assert got["d.pdf"] == [(1, "page", "Page one\nsecond")]
    assert got["e.eml"] == [(1, "header", "From: a@example.org\nSubject: Hi"), (2, "body", "the body")]
    assert got["f.txt"] == [(1, "text", "text")] and got["h.docx"][0][2] is None
    assert {r["kind"] for r in files.scan(spark, str(tmp_path), largest=3).collect()} >= {"oversize"}


def test_detection_order(spark):
    rows = [("text/html; application/pdf", "a.pdf", b"", "txt"), ("application/pdf", "a.txt", b"", "pdf"), ("image/zip", "x", b"", "image"), (None, "a.PNG", b"", "image"), (None, "a", b"PK\x03\x04 xl/", "xlsx"), (None, None, b"From: x", "eml"), (None, None, b"", "txt")]
    df = spark.createDataFrame([(c, n, bytearray(b), k) for c, n, b, k in rows], "c string, n string, b binary, k string")
    assert all(r["k"] == r["x"] for r in df.withColumn("x", detect.document_type(F.col("c"), F.col("n"), F.col("b"))).collect())


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    assert {tuple(r) for r in stores.upsert(old, new, "id").collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert [r["id"] for r in stores.delete(old, new, "id").collect()] == [1]
    log = spark.createDataFrame([(["q1", "q2"], ["a"])], "questions array<string>, answers array<string>")
    for _ in range(2):
        stores.append_log(spark, str(tmp_path / "log"), log)
    assert spark.read.parquet(str(tmp_path / "log")).where("n_questions = 2 and n_answers = 1").count() == 2
    trees_ = spark.createDataFrame([("http://x", "topic", '{"nodes": {"a": {}, "b": {}}}')], "url string, topic string, json string")
    stores.save_trees(trees_, str(tmp_path / "trees"))
    assert spark.read.parquet(str(tmp_path / "trees")).first()["n_nodes"] == 2
    assert stores.run_sql(spark, " select 1 as x ; ").first()["x"] == 1


def test_scanned_markdown(spark):
    from quillstone.functions import ocr

    raw = "<!-- PageNumber=\"3\" -->\n<b>Bold</b> <p>x</p><br/>1\\. one\n2.1 Scope of Cover\na) item\nNote: be aware\n\n<!-- PageBreak -->\n\n\n\nend"
    got = one(spark, ocr.clean_markdown(F.col("t")), raw)
    assert got.startswith("**Bold** x\n1. one\n### 2.1 Scope of Cover\n- **a)** item") and "**Note: be aware**" in got and "PageBreak" in got and "PageNumber" not in got
    tables_, rest = ocr.take_tables("a <table><tr><td>1</td></tr></table> <!-- PageBreak --> <table>x</table>")
    assert [(t["page_index"], t["pattern_type"]) for t in tables_] == [(1, 0), (0, 0)] and rest.count("PLACEHOLDER") == 2
    assert one(spark, ocr.page_index(F.col("t")), "a<!-- PageBreak -->b<!-- PageBreak -->") == 2
    assert one(spark, ocr.table_headers(F.col("t")), "<tr><th>A</th><th><b>B c</b></th></tr>") == ["a", "b c"]


def test_knowledge(spark):
    from quillstone.operators import knowledge as K

    d = spark.createDataFrame([("k", i, float(i)) for i in range(30)], "k string, text_id long, d double")
    seeds = {r["node"]: r["label"] for r in K.trusted_seeds(d, 2, 3).collect()}
    assert seeds == {0: 0, 1: 0, **{i: 1 for i in range(24, 30)}}
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(29) for a, b in ((i, i + 1), (i + 1, i))], "a long, b long, weight double")
    got = {r["text_id"] for r in K.membership(edges, K.trusted_seeds(d, 2, 3), 20).collect()}
    assert {0, 1, 2, 3} <= got and not got & set(range(20, 30))
    assert [r["text_id"] for r in K.related_texts(d, 2, "d", False).orderBy("rank").collect()] == [0, 1]
    found = spark.createDataFrame([(1, 7, [-1, 3])], "qid long, text_id long, via array<long>")
    assert {(r["src"], r["dst"]) for r in K.subgraph(found).collect()} == {("q1", "t7"), ("k3", "t7"), ("q1", "k3")}
    facts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "")], "qid long, place long, fact string")
    assert K.facts_context(facts).first()["context"] == "Source 1: a\n\nSource 2: b"
    K.register_pipeline("mine", lambda: None)
    assert K.pipeline("mine") and pytest.raises(KeyError, K.pipeline, "absent")


def test_more_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", '{"file_name": "f"}'), (2, "", "{}"), (3, "c", "broken"), (4, "d", '{"source": "s", "file_name": "f"}')], "id long, text string, meta string")
    assert {r["id"]: r["source"] for r in stores.resolve_sources(rows).collect()} == {1: "f", 3: "3", 4: "s"}
    assert {r["id"]: r["text"] for r in stores.update(rows, F.col("id") == 2, text="new").collect()}[2] == "new"
    nodes = spark.createDataFrame([(1, "x"), (2, "y")], "id long, tag string")
    edges = spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")
    left, kept = stores.clear_tagged(nodes, edges, F.col("tag") == "x")
    assert stores.counts_match(left, kept, 1, 1).first()["ok"]
    stores.save_graph({"nodes": nodes}, str(tmp_path / "g"))
    assert stores.load_graph(spark, str(tmp_path / "g"), ["nodes"])["nodes"].count() == 2
    cache = spark.createDataFrame([("http://x",)], "url string").select(stores.cache_key(F.col("url")).alias("key"))
    hits = stores.cached(cache, spark.createDataFrame([("http://x",), ("http://y",)], "url string"))
    assert {r["url"]: r["cached"] for r in hits.collect()} == {"http://x": True, "http://y": False}
    assert stores.clear_cache(cache, "http://x").count() == 0
    files.append_text(spark.createDataFrame([("line",)], "s string"), str(tmp_path / "t"))
    assert files.texts(spark, str(tmp_path / "t")).first()["content"] == "line" and files.listing(spark, str(tmp_path / "t"), "*.txt").count() == 1
    (tmp_path / "p.html").write_text("<title>T</title><script>x</script><p>a&amp;b</p>")
    assert files.pages(files.scan(spark, str(tmp_path), "*.html")).first()["content"] == "T\na&b"


def test_marks_of_files_are_bytes(spark):
    """Half-byte matches are none: these bytes hold the marks' hex digits only shifted by one digit."""
    rows = [(bytes.fromhex("504B0304" + "0776F72642F0"), "zip"), (bytes.fromhex("0467 26F6 D3A0".replace(" ", "")), "txt"), (b"PK\x03\x04..word/x", "docx"), (b"X\nFrom: a", "eml")]
    df = spark.createDataFrame([(bytearray(b), k) for b, k in rows], "b binary, k string")
    assert all(r["k"] == r["x"] for r in df.withColumn("x", detect.document_type(F.lit(None).cast("string"), F.lit("a"), F.col("b"))).collect())


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["tokens"] for r in chunks.token_counts(docs).collect()}
    assert got == {d: len(whole.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_url_quoting_is_the_standard_one(spark):
    from urllib.parse import quote

    for text in ("a b/c?d=e&f", "Market Cap > 500 AND x*y~z", "ünï 漢", "", "+%20"):
        assert one(spark, T.url_quoted(F.col("t")), text) == quote(text)


def test_streams_drain_to_shared_files(spark, tmp_path):
    from quillstone.streaming import streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "*.parquet")
    capped = streams.drain(streams.rate_cap(stream), "append")
    assert capped.count() == events.count() and capped.inputFiles()
    assert streams.drain(streams.window_counts(stream)).groupBy().sum("n").first()[0] == events.count()


def test_rate_cap_and_key_health_are_a_plain_replay(spark):
    from quillstone.plans import catalog, library  # noqa: F401

    rows = sorted(spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"]))
    begun, used, allowed, streak, until, healthy = {}, {}, {}, {}, {}, {}
    for r in rows:
        u, now = r["user_id"], r["ts"].timestamp()
        if u not in begun or now - begun[u] >= 60:
            begun[u], used[u] = now, 0
        used[u] += 1
        allowed[r["event_id"]] = used[u] <= 60
        healthy[r["event_id"]] = streak.get(u, 0) < 3 and now >= until.get(u, 0)
        if r["event_type"] == "error":
            streak[u] = streak.get(u, 0) + 1
            until[u] = now + 60 * min(2 * streak[u], 30)
        else:
            streak[u] = 0
    run = lambda name: catalog.QUERIES[name].run(spark, "/root/testdata/sf0.001").collect()
    assert {r["event_id"]: r["allowed"] for r in run("stream_rate_cap")} == allowed
    assert {r["event_id"]: r["healthy"] for r in run("stream_key_health")} == healthy


def test_importance_of_a_long_table_and_a_long_number(spark):
    """Rows whose patterns overflowed the stack of a task, which ended the executor."""
    rows = [(0, "|a b" * 30000 + "|"), (1, "1" + ".1" * 30000 + " all of it"), (2, "|a|"), (3, "|a|b|"), (4, "1.2.3 one\n1.2. two\n4.5\n\nthree")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["i"], r["l"], r["a"]) for r in df.select("id", T.importance(F.col("text")).alias("i"), T.re_count(F.col("text"), T.LISTS).alias("l"), F.size(T.re_all(F.col("text"), T.LISTS)).alias("a")).collect()}
    assert got[0] == pytest.approx((6 * 1.4, 0, 0)) and got[1] == pytest.approx((1.5 * 1.4, 1, 1))
    assert got[2][0] == pytest.approx(1.0 * (1 + 0.003 * 0.2)) and got[3][0] == pytest.approx(6.0 * (1 + 0.005 * 0.2))
    assert got[4][1:] == (2, 2)
    assert one(spark, O.clean_markdown(F.col("t")), "1" + ".1" * 30000 + " All of it\n1.2 B").endswith(".1 All of it\n### 1.2 B")


def test_first_adjacent_words_of_small_and_large_groups(spark):
    """As all pairs have them; a group of 40,000 words, whose pairs would be 1.6 billion, is no more than its words."""
    rows = [(i, i % 3 or None, 0) for i in range(40)] + [(5, 1, 0), (7, 2, 1), (8, 2, 1)]
    got = sorted((r["k1"], r["k2"], r["rank"]) for r in graph.first_adjacent(spark.createDataFrame(rows, "k long, label long, text_id long"), ["label", "text_id"]).collect())
    want = []
    for k in sorted({r[0] for r in rows}):
        near = sorted(b[0] for a in rows for b in rows if a[0] == k and b[0] != k and a[1] is not None and a[1:] == b[1:])
        want += [(k, b, i + 1) for i, b in enumerate(near[:3])]
    assert got == want
    large = spark.range(40000).select(F.col("id").alias("k"), F.lit(1).alias("label"), F.lit(2).alias("text_id"))
    found = graph.first_adjacent(large, ["label", "text_id"])
    assert found.agg(F.count("*"), F.max("k2"), F.max("rank")).first()[:] == (120000, 3, 3)
