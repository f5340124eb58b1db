"""Forms are infused once, in their rows, and come to their tokens by slices."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import lattice
from lexloom.plans import catalog
from tests.test_slices import shuffles

E = "array<struct<from_node: int, to_node: int, form: string, cpos: string>>"


@pytest.mark.parametrize("edges", [False, True])
def test_rows_are_infused_as_tables_are(spark, edges):
    w, a, b = (0, 2, "ab", "W"), (0, 1, "a", "P"), (1, 2, "b", "X")
    rows = [(1, [w], [a, b]), (2, [a, b], [w]), (3, [w], [(0, 2, "ab", "ZZ")]), (4, [w, a, b], [a, b]), (5, [w], []), (6, [a, (1, 2, "H", "D"), (0, 2, "q", "Y")], [(0, 1, "a", "P"), (1, 2, "c", "X")])]
    rows = spark.createDataFrame(rows, f"s int, c {E}, g {E}").withColumn("tok_no", F.lit(1))
    got = lattice.infused_rows(rows.withColumnsRenamed({"c": "x", "g": "y"}), F.col("x"), F.col("y"), edges).select("s", "tok_no", F.inline("e"))
    side = lambda c: rows.select("s", "tok_no", F.inline(c))
    want = (lattice.infuse_edges if edges else lattice.infuse_lattices)(side("c"), side("g"), ["s"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_sentences_without_candidates_are_left_out(spark):
    edge = "s int, tok_no int, from_node int, to_node int, form string, cpos string"
    c = spark.createDataFrame([(1, 1, 0, 1, "ab", "W")], edge)
    g = spark.createDataFrame([(1, 1, 0, 1, "ab", "W"), (1, 2, 1, 2, "c", "X"), (2, 1, 0, 1, "ab", "W")], edge)
    got = lattice.infuse_known(c, g, ["s"])
    assert sorted(map(str, got.collect())) == sorted(map(str, lattice.infuse_lattices(c, g.filter("s = 1"), ["s"]).collect()))


@pytest.mark.parametrize("name", ["j11_infuse_lattices", "j12_infuse_edges", "j11_deep_infuse"])
def test_tokens_are_shuffled_by_slice_alone(spark, sf, name):
    by = shuffles(catalog.QUERIES[name](spark, sf))
    assert "slice" in by and not [x for x in by if "line_no" in x or "tok_no" in x]
