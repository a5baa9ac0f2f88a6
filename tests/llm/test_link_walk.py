"""The walk over absolute links, against its SQL and a plain power iteration."""

import random

import duckdb
import numpy as np
import pytest

from quillstone.llm import urls


def site(rng):
    """Pages of 60 hosts that link to each other, some of them ruled, and a chain of 15 hosts that ends at a blocked one."""
    hosts = [f"h{i}.test" for i in range(60)] + ["good.example.com", "shop.example.com", "bad.com", "worse.org", "www.fine.net"]
    pages = []
    for h in hosts:
        for k in range(rng.randint(1, 4)):
            links = "".join(rng.choice([f"<a href='http://{x}/p'>", f'<A HREF="//{x}">', f"<a href=https://{x.upper()}?q>"]) for x in rng.sample(hosts, rng.randint(0, 4)))
            path = rng.choice(["/en/7", "/en/1", "/de/3", "/es/2", "/"])
            pages.append((len(pages), f"https://{h}{path}", f"<html>{links}</html>"))
    for i in range(15):
        pages.append((len(pages), f"http://c{i}.chain{i}/x", f"<a href='http://c{i + 1}.chain{i + 1}/'>"))
    pages.append((len(pages), "http://c15.chain15/x", "<a href='http://end.org/'>"))
    pages.append((len(pages), "http://end.org/es/1", None))
    return pages


@pytest.mark.parametrize("seed", [1, 2])
def test_absolute_links_are_walked_to_the_residual(spark, seed):
    pages = site(random.Random(seed))
    got = {r["page_id"]: (r["host"], r["verdict"], r["rule"]) for r in urls.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), urls.RULES).collect()}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    want = {r[0]: (r[1], r[4], r[3]) for r in con.execute(urls.oracle()).fetchall()}
    assert got == want and len({v for _, v, _ in got.values()}) == 2
    # the whole chain before a blocked host is blocked, all 16 hops of it
    assert all(v == "block" for h, v, _ in got.values() if h.startswith("c") and "chain" in h)
    assert urls.residual() < 1e-6


def test_masses_are_those_of_a_power_iteration(spark):
    rng = random.Random(5)
    n = 30
    edges = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 5))) for _ in range(90)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges if a != b}.values())
    seeds = [(0, 2.0), (7, 1.0), (9, 1.0)]
    e = spark.createDataFrame([("trust", str(a), str(b), w) for a, b, w in edges], "kind string, src string, dst string, weight double")
    s = spark.createDataFrame([("trust", str(a), m) for a, m in seeds], "kind string, node string, mass double")
    got = {int(r["node"]): r["mass"] for r in urls.propagate(e, s).collect()}
    step = np.zeros((n, n))
    for a, b, w in edges:
        step[b, a] = w
    step = step / np.maximum(step.sum(axis=0), 1e-300)
    start = np.zeros(n)
    for a, m in seeds:
        start[a] = m / 4
    exact = 0.15 * np.linalg.solve(np.eye(n) - 0.85 * step, start)
    assert all(abs(got.get(i, 0.0) - exact[i]) <= urls.residual() for i in range(n))
