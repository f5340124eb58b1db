"""Back-off along gold paths, nested records and unknown features, worked out by hand."""

from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import depgraph, evaluation, learn

EDGE = "t int, from_node int, to_node int, form string, cpos string"


def walked(spark, gold, candidates):
    keys = [("Form_POS", F.concat_ws("_", "form", "cpos")), ("POS", F.col("cpos")), ("Form", F.col("form"))]
    g, c = spark.createDataFrame(gold, EDGE), spark.createDataFrame(candidates, EDGE)
    return sorted(((r.t, r.morph_idx, r.level, r.n_matches, r.from_node, r.to_node, r.form) for r in evaluation.backoff_match(g, c, ["t"], keys).collect()), key=str)


def test_matches_start_where_the_walk_is(spark):
    """The gold b is at node 2 of the lattice only; the walk is at node 0, where a and c start."""
    cand = [(1, 0, 2, "a", "X"), (1, 0, 2, "c", "Y"), (1, 2, 3, "b", "Z")]
    assert walked(spark, [(1, 0, 1, "b", "Q")], cand) == [(1, 0, "none", 0, 0, None, None)]
    assert walked(spark, [(1, 0, 1, "a", "X"), (1, 1, 2, "b", "Z")], cand) == [(1, 0, "Form_POS", 1, 0, 2, "a"), (1, 1, "Form_POS", 1, 2, 3, "b")]


def test_last_of_several_matches_and_back_off(spark):
    cand = [(1, 0, 1, "a", "X"), (1, 0, 2, "b", "X"), (1, 1, 3, "c", "Y"), (1, 2, 3, "d", "Y")]
    assert walked(spark, [(1, 0, 1, "q", "X"), (1, 1, 2, "d", "W")], cand) == [(1, 0, "POS", 2, 0, 2, "b"), (1, 1, "Form", 1, 2, 3, "d")]


def test_a_lone_proper_noun_is_left(spark):
    cand = [(1, 0, 1, "a", "NNP"), (1, 1, 2, "c", "Y"), (2, 0, 1, "a", "NNP"), (2, 0, 1, "b", "NNP")]
    got = walked(spark, [(1, 0, 1, "q", "X"), (1, 1, 2, "c", "Y"), (2, 0, 1, "q", "X"), (2, 1, 2, "c", "Y")], cand)
    assert got == [(1, 0, "oov", 0, 0, 1, "a"), (1, 1, "Form_POS", 1, 1, 2, "c"), (2, 0, "none", 0, 0, None, None)]


def test_training_record_is_one_row(spark):
    arcs = spark.createDataFrame([(1, 2, 0, "root"), (1, 1, 2, "subj"), (2, 1, 0, "root")], "s int, id int, head int, deprel string")
    morphs = "array<struct<form: string, cpos: string>>"
    gold = spark.createDataFrame([(1, 1, [("a", "X")]), (1, 2, [("b", "Y")])], f"s int, tok_no int, morphs {morphs}")
    cand = spark.createDataFrame([(1, 1, [("a", "X")]), (1, 1, [("a", "W")]), (1, 2, [("b", "Y")]), (2, 1, [("c", "Z")])], f"s int, tok_no int, morphs {morphs}")
    one, two = depgraph.training_record(arcs, gold, cand, ["s"]).orderBy("s").collect()
    assert [tuple(x) for x in one.tree] == [(1, 2, "subj"), (2, 0, "root")] and [x.tok_no for x in one.gold] == [1, 2]
    assert [[[m.cpos for m in p] for p in x.paths] for x in one.lattice] == [[["W"], ["X"]], [["Y"]]] and one.complete
    assert two.gold is None and not two.complete and len(two.tree) == 1


def test_unknown_features_are_named(spark):
    one = spark.range(1).select(text.universal_feats(F.lit("gen=F|zzz=Q")).alias("u"), text.unknown_feats(F.lit("gen=F|zzz=Q|_")).alias("n"), text.unknown_feats(F.lit("_")).alias("o")).first()
    assert one.u == "Gender=Fem" and one.n == ["zzz=Q"] and one.o == []


def test_best_epoch(spark):
    h = spark.createDataFrame([(0, 1, 4), (1, 3, 4), (2, 3, 4), (3, 2, 4)], "epoch int, right int, n int")
    assert [r.epoch for r in learn.history_changes(h).collect() if r.best] == [1]


def test_rows_of_tokens_walk_as_tables_do(spark):
    E = "array<struct<from_node: int, to_node: int, form: string, cpos: string>>"
    w, a, b, n = (0, 2, "ab", "W"), (0, 1, "a", "P"), (1, 2, "b", "X"), (0, 1, "q", "NNP")
    made = [(1, [a, b], [w, a, b, a]), (2, [(0, 1, "a", "ZZ"), (1, 2, "c", "X")], [w, a, b]), (3, [w], [n]), (4, [w], []), (5, [(0, 2, "z", "Y")], [a]), (6, [], [a]), (7, [(0, 1, None, "P")], [(0, 1, None, None)])]
    rows = spark.createDataFrame(made, f"t int, x {E}, y {E}")
    side = lambda c: rows.select("t", F.inline(c))
    want = evaluation.backoff_match(side("x"), side("y"), ["t"], [("both", F.concat_ws("_", "form", "cpos")), ("tag", F.col("cpos"))])
    got = evaluation.steps(evaluation.backoff_rows(rows, F.col("x"), F.col("y"), [("both", lambda e: F.concat_ws("_", e["form"], e["cpos"])), ("tag", lambda e: e["cpos"])]), ["t"])
    assert want.dtypes == got.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tokens_are_shuffled_by_slice_alone(spark, sf):
    from lexloom.plans import catalog
    from tests.test_slices import shuffles

    by = shuffles(catalog.QUERIES["j20_backoff_match"](spark, sf))
    assert "slice" in by and not [x for x in by if "line_no" in x or "tok_no" in x]
