"""What the searches of keyword vectors move: packs in small batches, and a row for a text's keyword."""

from quillstone.functions import pivots
from quillstone.plans import graph_learning

SF = "/root/testdata/sf0.001"


def test_packs_go_to_python_a_few_at_a_time(spark, monkeypatch):
    seen, real, batch = [], pivots.cut, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(pivots, "cut", lambda df: (seen.append(("q_flat" in df._jdf.queryExecution().analyzed().toString(), int(spark.conf.get(batch)))), real(df))[1])
    before = spark.conf.get(batch)
    graph_learning._search(spark, SF, "id % 20 = 0", 5)
    assert spark.conf.get(batch) == before
    compared = [n for packs, n in seen if packs]
    assert len(compared) == 2 and max(compared) <= pivots.PACKS


def test_means_without_a_row_for_each_number(spark, monkeypatch):
    means = graph_learning._keywords(spark, SF)
    assert "posexplode" not in means._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["id"], r["v"]) for r in means.collect()}
    monkeypatch.setattr(graph_learning, "WIDEST", 0)
    assert got and got == {r["k"]: (r["id"], r["v"]) for r in graph_learning._keywords(spark, SF).collect()}
