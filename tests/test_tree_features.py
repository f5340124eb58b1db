"""Features of arcs, conversions and token ids on small trees, worked out by hand."""

import pytest

from lexloom.operators import depgraph
from lexloom.sources import readers

# a <- b -> c -> d, with e below c too: ids 1 to 5, root 2
TREE = "s int, id int, head int, deprel string, form string, cpos string, host string, suffix string"
ROWS = [(1, 1, 2, "subj", "a", "N", "g=F", None), (1, 2, 0, "root", "b", "V", None, None), (1, 3, 2, "obj", "c", "N", None, "x=1"), (1, 4, 3, "mod", "d", "J", None, None), (1, 5, 3, "mod", "e", "J", None, None), (2, 1, None, None, "z", "N", None, None)]


def found(spark, templates):
    arcs = spark.createDataFrame(ROWS, TREE).repartition(3)
    return {(r.id, r.head): r.features for r in depgraph.arc_features(arcs, ["s"], templates).collect()}


def test_arc_features(spark):
    got = found(spark, ["# comment", "S0|w + N0|w|p|d, S0|w", "N1|w,N1|w", "S0h|w|l,S0h|w", "S0l|w,S0l|w", "S0r|w+S0r2|w,S0r2|w", "N0h2|w,n/a", "S0|vl|vr|sr|fp,n/a", "S0|h,S0|h", "N0|x,N0|x"])
    assert got == {
        (1, 2): ["S0|w+N0|w|p|d=a~b~V~1", "N1|w=c", "S0h|w|l=b~root", "N0h2|w=", "S0|vl|vr|sr|fp=0~0~~", "S0|h=g=F"],
        (3, 2): ["S0|w+N0|w|p|d=b~c~N~1", "N1|w=d", "S0l|w=a", "N0h2|w=", "S0|vl|vr|sr|fp=1~1~obj~N,N", "N0|x=x=1"],
        (4, 3): ["S0|w+N0|w|p|d=c~d~J~1", "N1|w=e", "S0h|w|l=b~root", "S0r|w+S0r2|w=e~d", "N0h2|w=b", "S0|vl|vr|sr|fp=0~2~mod~J,J"],
        (5, 3): ["S0|w+N0|w|p|d=c~e~J~2", "S0h|w|l=b~root", "S0r|w+S0r2|w=e~d", "N0h2|w=b", "S0|vl|vr|sr|fp=0~2~mod~J,J"],
    }


@pytest.mark.parametrize("template", ["S1|w,n/a", "S0|o,n/a", "S0q|w,n/a", "S0|at_l,n/a"])
def test_parser_states_are_errors(spark, template):
    with pytest.raises(ValueError):
        found(spark, [template])


def test_has_arcs(spark):
    arcs = spark.createDataFrame(ROWS, TREE)
    assert {(r.s, r.id): (r.has_head, r.has_modifiers) for r in depgraph.has_arcs(arcs, ["s"]).collect()} == {(1, 1): (True, False), (1, 2): (True, True), (1, 3): (True, True), (1, 4): (True, False), (1, 5): (True, False), (2, 1): (False, False)}


def test_conversions_of_absent_arcs(spark):
    rows = [(1, 1, 1, "a", "a", "", "N", "N", "", None, None), (1, 2, 1, "a", "b", "", "V", "V", "g=F", 1, "ROOT"), (1, 3, 2, "c", "c", "", "N", "N", "", 2, "obj")]
    t = spark.createDataFrame(rows, "s int, id int, tok_no int, token string, form string, lemma string, cpos string, pos string, feat_str string, head int, deprel string")
    assert [(r.head, r.deprel) for r in depgraph.to_conll(t, ["s"]).orderBy("id").collect()] == [(0, "None"), (0, "ROOT"), (2, "obj")]
    assert [(r.head, r.deprel, r.upos) for r in depgraph.to_conllu(t, ["s"]).orderBy("id").collect()] == [(2, "punct", "N"), (0, "ROOT", "V"), (2, "obj", "N")]
    assert [(r.from_node, r.to_node, r.feat_str) for r in depgraph.to_lattice(t, ["s"]).orderBy("to_node").collect()] == [(0, 1, "_"), (1, 2, "g=F"), (2, 3, "_")]
    assert [tuple(x) for x in depgraph.to_tagged(t, ["s"]).first().tagged] == [("a", "N"), ("b", "V"), ("c", "N")]


def test_trees_from_universal_rows(spark, tmp_path):
    lines = ["1-2\tabc\t_\t_\t_\t_\t_\t_\t_\t_", "1\ta\t_\tADP\tIN\t_\t2\tcase\t_\t_", "2\tbc\tbcd\tNOUN\tNN\tgen=F|suf_gen=M\t0\troot\t_\t_"]
    (tmp_path / "x.conllu").write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    rows = depgraph.from_conllu(readers.read_conllu(spark, f"file://{tmp_path}/x.conllu"), ["path", "block"], "either").orderBy("id").collect()
    assert [(r.tok_no, r.token, r.word, r.word_pos, r.pos, r.host, r.suffix, r["head"], r.deprel) for r in rows] == [(1, "abc", "a", "a~ADP", "IN", "_", "_", 2, "case"), (1, "abc", "bcd", "bcd~NOUN", "NN", "gen=F", "suf_gen=M", 0, "root")]


def test_arc_features_shuffle_lines_alone(spark, sf):
    from lexloom.plans import catalog
    from tests.test_slices import shuffles

    assert shuffles(catalog.QUERIES["f1_f3_arc_features"](spark, sf)) == ["doc_id, line_no"]


def test_attributes_with_nulls_and_repeated_ids(spark):
    from lexloom.operators import depgraph

    rows = [(1, 1, 0, "r", "a"), (1, 2, 1, "x", "b"), (1, 3, 1, None, "c"), (1, 3, 1, "y", "d"), (1, 4, None, "z", "e"), (1, 5, 9, "q", "f")]
    arcs = spark.createDataFrame(rows, "s int, id int, head int, deprel string, form string").selectExpr("*", "upper(form) cpos", "'h' host", "'x' suffix")
    got = {(r.id, r.w): (r.l, r.vl, r.vr, r.vf, r.sl, r.sr, r.sf, r.fp, r.at_l, r.at_r, r.at_r2) for r in depgraph._token_attributes(arcs, ["s"]).collect()}
    assert len(got) == 6 and got[(1, "a")] == ("r", "0", "3", "3", "", "x,y", "x,y", "B,C,D", None, 3, 3)
    assert got[(4, "e")][0] is None and got[(5, "f")] == ("q", "0", "0", "0", "", "", "", "", None, None, None)
