"""The tables of the policy graph: entities are looked for once, whatever is counted of them."""

from quillstone.operators import knowledge


def test_entities_are_looked_for_once(spark):
    docs = spark.createDataFrame([(1, "# One\nThe sum insured is Rs. 500 on 12/03/2024.\n# Two\nDr Smith of Acme Ltd pays Rs. 500."), (2, ""), (3, None)], "doc_id long, text string")
    parts = knowledge.policy_graph(docs)
    for name in ("entities", "mentions"):
        plan = parts[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" not in plan
    assert parts["mentions"].select("kind", "name").distinct().count() == parts["entities"].count()
