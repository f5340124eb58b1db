"""Small lattices, worked out by hand."""

from pyspark.sql import functions as F

from lexloom.operators import depgraph, evaluation, lattice

LEMMA = "t long, from_node int, to_node int, form string, cpos string, lemma string"


def edges(spark, rows, schema="t long, from_node int, to_node int, form string, cpos string"):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_bridge_needs_an_edge_to_go_on_to(spark):
    e = edges(spark, [(1, 0, 1, "a", "X"), (1, 0, 3, "b", "X"), (2, 0, 1, "a", "X"), (2, 2, 3, "c", "X"), (2, 0, 3, "b", "X")])
    assert got(lattice.bridge(e, ["t"]), "t", "from_node", "to_node") == [(1, 0, 1), (1, 0, 3), (2, 0, 2), (2, 0, 3), (2, 2, 3)]


def test_meet_and_join_count_edges(spark):
    # 0 -> 4 directly and by 1, 2, 3; both 1 and 4 lead to 5
    e = edges(spark, [(1, a, b, "x", "X") for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (4, 5), (1, 5))])
    found = {(r.x, r.y): (r.meet, r["join"]) for r in lattice.meet_join(e, ["t"]).collect()}
    assert found[(1, 4)] == (1, 4) and found[(2, 5)] == (2, 5) and found[(3, 5)] == (3, 5) and found[(0, 5)] == (0, 5)
    e = edges(spark, [(1, a, b, "x", "X") for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (1, 4), (2, 4))])
    found = {(r.x, r.y): (r.meet, r["join"]) for r in lattice.meet_join(e, ["t"]).collect()}
    assert found[(1, 2)] == (0, 3)


def test_fused_prefix_goes(spark):
    e = edges(spark, [(1, 0, 1, "B", "P"), (1, 0, 2, "B", "P"), (1, 1, 2, "H", "DEF"), (1, 2, 3, "W", "NN"), (2, 0, 1, "M", "P"), (2, 0, 2, "M", "P"), (2, 1, 2, "H", "DEF"), (2, 2, 3, "W", "NN")])
    rows = got(lattice.repair_fused_h(e, ["t"]), "t", "from_node", "to_node", "form")
    assert rows == [(1, 0, 1, "B"), (1, 1, 2, "H"), (1, 1, 3, "W"), (1, 2, 3, "W"), (2, 0, 1, "M"), (2, 0, 2, "M"), (2, 1, 2, "H"), (2, 2, 3, "W")]


def test_clitic_is_taken_in(spark):
    schema = "t long, from_node int, to_node int, form string, cpos string, feat_str string"
    e = edges(spark, [(1, 0, 1, "ECMW", "PRP", "_"), (1, 1, 2, "HWA", "S_PRN", "gen=M"), (2, 0, 1, "ECMW", "PRP", "_"), (2, 1, 2, "HWA", "NN", "gen=M"), (3, 0, 1, "X", "PRP", "_"), (3, 1, 2, "HWA", "S_PRN", "_")], schema)
    rows = got(lattice.merge_clitics(e, ["t"]), "t", "from_node", "to_node", "form", "feat_str")
    assert rows == [(1, 0, 2, "ECMW", "gen=M"), (2, 0, 1, "ECMW", "_"), (2, 1, 2, "HWA", "gen=M"), (3, 0, 1, "X", "_"), (3, 1, 2, "HWA", "_")]


def test_gold_path_is_followed(spark):
    gold = edges(spark, [(t, 0, 1, "a", "X") for t in (1, 2, 3, 4)] + [(t, 1, 2, "b", "Y") for t in (1, 2, 3, 4)])
    cand = [(t, 1, 2, "b", "Y", lemma) for t in (1, 2, 3) for lemma in ("b1", "b2")]
    cand += [(1, 0, 1, "a", "X", "a1"), (1, 0, 1, "a", "X", "a2")]  # two lemmas, one end: goes on
    cand += [(2, 0, 1, "a", "X", "a1"), (2, 0, 2, "a", "X", "a2")]  # two lemmas, two ends: over
    cand += [(3, 0, 1, "a", "X", "a1"), (3, 0, 2, "a", "X", "a1")]  # one lemma, ends here or goes on
    cand += [(4, 0, 1, "z", "X", "z1"), (4, 0, 2, "b", "Y", "b9")]  # the first is absent: the node stays
    cand = edges(spark, cand, LEMMA)
    amb = lattice.ambiguous_lemmas(gold, cand, ["t"], ["form", "cpos"]).withColumn("l", F.array_join("lemmas", ","))
    assert got(amb, "t", "morph_idx", "l") == [(1, 0, "a1,a2"), (1, 1, "b1,b2"), (2, 0, "a1,a2"), (3, 1, "b1,b2")]
    assert got(lattice.suffix_conflicts(gold, cand, ["t"], ["form", "cpos"]), "t", "morph_idx", "lemma") == [(3, 0, "a1")]
    assert got(lattice.unambiguous_lemmas(gold, cand, ["t"], [["form", "cpos"], ["cpos"]]), "t", "morph_idx", "level", "lemma") == [(4, 0, 1, "z1")]


def test_what_is_left_out_is_no_error(spark):
    p, g = (spark.createDataFrame([(1, x) for x in v], "t long, k string") for v in (["a"], ["a", "b"]))
    assert got(evaluation.morph_scores(p, g, ["t"], F.col("k")), "tp", "fp", "missed_gold", "status") == [(1, 0, 1, "Success")]
    assert got(evaluation.morph_scores(g, p, ["t"], F.col("k")), "status") == [("Error",)]


def test_exact_match_keeps_the_order(spark):
    p, g = (spark.createDataFrame([(1, i, x) for i, x in enumerate(v)] + [(2, 0, "c")], "s long, id int, form string") for v in ("ab", "ba"))
    r = evaluation.segment_f1(p, g, ["s"], ["id"], {"seg": ["form"]}).collect()[0]
    assert (r.tp, r.f1, r.em) == (3, 1.0, 0.5)


def test_root_label_hangs_from_the_root(spark):
    arcs = spark.createDataFrame([(1, 1, 3, "ROOT"), (1, 2, None, None), (1, 3, 1, "x"), (2, 1, None, None), (2, 2, 1, "x"), (2, 3, None, None)], "s long, id int, head int, deprel string")
    assert got(depgraph.attach_orphans(arcs, ["s"]), "s", "id", "head", "deprel") == [(1, 1, 0, "ROOT"), (1, 2, 1, "punct"), (1, 3, 1, "x"), (2, 1, 0, "root"), (2, 2, 1, "x"), (2, 3, 1, "punct")]
