"""Places and running sums over ranges against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators.numbering import numbered


@pytest.mark.parametrize("keys", [["g"], [], ["g", "h"]])
def test_places_and_sums(spark, keys):
    rng = random.Random(len(keys))
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 0.5, 1.5, 2.5]), rng.randint(-3, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, h int, x double, n long").repartition(7)
    got = {r["id"]: (r["at"], r["sum"]) for r in numbered(df, keys, [F.col("x").desc(), F.col("id")], "at", "n", "sum").collect()}
    at = {"g": 1, "h": 2}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])):  # nulls last where the order falls
        groups.setdefault(tuple(r[at[k]] for k in keys), []).append(r)
    for own in groups.values():
        total = 0
        for place, r in enumerate(own, 1):
            total += r[4]
            assert got[r[0]] == (place, total)
    assert len(got) == 900
    assert numbered(df.limit(0), keys, [F.col("id")]).count() == 0
