"""Chains longer than any number of rounds: where a loop counts its rounds, the count is cut to a few."""

import builtins

from terracol.operators import graph as G
from terracol.operators import joins as J


def few(*ends):
    return builtins.range(*[min(e, 3) for e in ends])


def test_merge_settles_the_whole_chain(spark, monkeypatch):
    monkeypatch.setattr(J, "range", few, raising=False)
    line = spark.createDataFrame([(i, i * 0.5, 0.0, 1.0) for i in builtins.range(12)], "idx long, lon double, lat double, pci double")
    assert sorted(r["idx"] for r in J.merge_close_points(line, 0.6).collect()) == [0, 2, 4, 6, 8, 10]


def test_paths_reach_a_far_stop(spark, monkeypatch):
    monkeypatch.setattr(G, "range", few, raising=False)
    row = spark.createDataFrame([(0, i) for i in builtins.range(7)], "row int, col int")
    pairs = spark.createDataFrame([(1, 0, 0, 0, 6, 0, 0, 0, 6)], "pair_id int, r0 int, c0 int, r1 int, c1 int, a int, b int, c int, d int")
    assert sorted((r["step"], r["col"]) for r in G._paths_together(row, pairs).collect()) == [(i, i) for i in builtins.range(7)]
