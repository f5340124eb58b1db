"""Lattices that are one row each are followed as those of edges are, without a shuffle."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import lattice
from lexloom.plans import catalog


def test_walks_of_rows_equal_those_of_edges(spark):
    edges = [("a", 0, 1, "x", "P", "l"), ("a", 0, 1, "x", "P", "m"), ("a", 1, 2, "y", "X", "n"), ("a", 1, 2, "y", "X", "n"), ("b", 0, 2, "z", "X", "q"), ("b", 0, 1, "z", "X", "q"), ("b", 1, 2, "w", "X", None), ("c", 0, 1, "v", "X", "r")]
    cand = spark.createDataFrame(edges, "t string, from_node int, to_node int, form string, cpos string, lemma string")
    gold = spark.createDataFrame([("a", 0, 1, "x", "P"), ("a", 1, 2, "y", "X"), ("b", 0, 1, "z", "X"), ("b", 1, 2, "w", "X"), ("d", 0, 1, "v", "X")], "t string, from_node int, to_node int, form string, cpos string")
    one = lambda df, name: df.groupBy("t").agg(F.collect_list(F.struct(*df.columns[1:])).alias(name))
    rows = one(gold, "gold").join(one(cand, "candidates"), "t")
    for keys in ([["form", "cpos"]], [["form", "cpos"], ["cpos"]]):
        want, got = lattice.follow(gold, cand, ["t"], keys), lattice.follow(rows, None, ["t"], keys)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


@pytest.mark.parametrize("name", ["g6_ambiguous_lemmas", "g7_unambiguous_lemmas", "g8_suffix_conflicts"])
def test_lemma_queries_join_once(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
