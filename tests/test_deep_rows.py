"""Deep lattices are searched in the rows of counted forms: tokens are shuffled once, by form."""

import re

import pytest

from lexloom.operators import lattice
from lexloom.plans import catalog

DEEP = ["a23_path_counts", "p14_deep_var_len", "p15_single_paths", "g1_deep_paths", "g2_deep_fused"]


@pytest.mark.parametrize("name", DEEP)
def test_tokens_are_shuffled_once_by_form(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    by = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange \w+\(([^()]*?), \d+\)", plan)]
    assert by == ["form"]


def test_rows_of_tokens_give_what_edges_give(spark):
    E = "array<struct<from_node: int, to_node: int, form: string, cpos: string>>"
    rows = [(1, [(0, 1, "a", "X"), (0, 1, "a", "X"), (0, 2, "ah", "Y"), (1, 2, "H", "Z")]), (2, [(0, 1, "q", "X")]), (3, [(0, 1, "H", "X"), (1, 2, "b", "X"), (1, 2, "b", "Y"), (4, 5, "c", "X")]), (4, [])]
    rows = spark.createDataFrame(rows, f"t int, edges {E}")
    edges = rows.selectExpr("t", "inline(edges)")
    same = lambda f: sorted(map(str, f(rows).collect())) == sorted(map(str, f(edges).collect()))
    assert same(lambda e: lattice.path_counts(e, ["t"])) and same(lambda e: lattice.paths(e, ["t"])) and same(lambda e: lattice.paths(e, ["t"], 1)) and same(lambda e: lattice.is_var_len(e, ["t"]))
    assert same(lambda e: lattice.single_path(e, ["t"])[0]) and same(lambda e: lattice.single_path(e, ["t"])[1]) and same(lambda e: lattice.fused_forms(e, ["t"], every_node=True)) and same(lambda e: lattice.fused_forms(e, ["t"]))
    assert lattice.paths(rows, ["t"], 0).collect() == []
