"""Large groups are compared in rounds: every link is found, near copies cost their number, not its square."""

import random

import pytest

from weftgraph.llm import shingle_join
from weftgraph.operators.components import connected_components


@pytest.mark.parametrize("kind", ["copies", "strangers"])
def test_rounds(spark, monkeypatch, kind):
    monkeypatch.setattr(shingle_join, "TILE", 40)
    rng = random.Random(1)
    n = 800 if kind == "copies" else 100
    of = {i: {"copies": 0 if i % 40 else i, "strangers": rng.randint(0, 70)}[kind] for i in range(n)}
    compared = []

    def solve(members):
        """Links of equal values that meet in a group, each with the next."""
        rows = [tuple(r) for r in members.collect()]
        compared.append(len(rows))
        by = {}
        for g, i in rows:
            by.setdefault((g, of[i]), []).append(i)
        links = [(a, b) for ids in by.values() for a, b in zip(sorted(ids), sorted(ids)[1:], strict=False)]
        return spark.createDataFrame(links, shingle_join.LINK)

    groups = spark.createDataFrame([(7, i, n) for i in of] + [(8, 0, 2), (8, 1, 2)], "g long, id long, m long")
    got = {r["node"]: r["component"] for r in connected_components(shingle_join.in_rounds(groups, solve)).collect()}
    first = {}
    for i, v in of.items():
        first.setdefault(v, i)
    shared = {v for v in of.values() if list(of.values()).count(v) > 1}
    assert got == {i: first[v] for i, v in of.items() if v in shared}
    if kind == "copies":  # 20 strangers are one tile: everyone meets them once, and once his own tile
        assert sum(compared) < 6 * n
