"""Entries of several morphemes, worked out by hand."""

import pytest

from lexloom.operators import lexicon
from lexloom.sources import readers


def keys(rows, name="morphs"):
    return sorted(";".join(f"{m.form}_{m.cpos}" + (f"({m.feat_str})" if m.feat_str else "") for m in r[name]) for r in rows)


def test_pronouns_of_a_lexicon_become_morphemes(spark, tmp_path):
    (tmp_path / "lex").write_text("BITW :NN-M-S:S-M-S-3 BIT\nAWTW :IN:-M-S-3 AT\nRAHW :VB-M-S-3:S-F-S-3 RAH\nHBIT DEF:NN-M-S: BIT\nQW :VB-M-S-3:S_ANP-M-S-3 Q\n", encoding="utf-8")
    rows = lexicon.lexicon_entries(readers.read_lexicon(spark, f"file://{tmp_path}/lex")).collect()
    got = {r.token: keys([r]) for r in rows}
    assert got["BITW"] == ["BITW_NN(gen=M|num=S|gen=M|num=S|per=3)"]  # the noun takes the suffix' features itself
    assert got["AWTW"] == ["AT_IN;הוא_S_PRN(gen=M|num=S|per=3)"]
    assert got["RAHW"] == ["RAH_VB(gen=M|num=S|per=3);את_POS;היא_S_PRN(gen=F|num=S|per=3)"]
    assert got["HBIT"] == ["HBIT_NN(gen=M|num=S|def=D)"]
    assert got["QW"] == ["QW_VB(gen=M|num=S|per=3)"]


@pytest.fixture(scope="module")
def parts(spark):
    morph = "array<struct<form: string, lemma: string, cpos: string, feat_str: string>>"
    entries = spark.createDataFrame([("bit", [("bit", "bit", "NN", "")]), ("raw", [("ra", "ra", "VB", ""), ("w", "w", "S_PRN", "")]), ("bit", [("bit", "bit", "VB", "")])], f"token string, morphs {morph}")
    prefixes = spark.createDataFrame([("k", [("k", "IN")]), ("wkfm", [("w", "CONJ"), ("kfm", "TEMP")]), ("k", [("k", "IN"), ("h", "DEF")])], "prefix string, morphs array<struct<form: string, cpos: string>>")
    oov = spark.createDataFrame([("NNP|NNP|gen=M",), ("NN|NN|",)], "oov_msr string")
    return entries, prefixes, oov


def analysed(spark, parts, *forms):
    rows = lexicon.analyze_morphs(spark.createDataFrame([(f,) for f in forms], "form string"), *parts).collect()
    return {f: (keys([r for r in rows if r.form == f]), {r.oov for r in rows if r.form == f}) for f in forms}


def test_prefixes_of_any_length_and_several_morphemes(spark, parts):
    got = analysed(spark, parts, "raw", "kraw", "wkfmraw", "bit", "k12", "12")
    unknown = lambda f: [f"{f}_NNP(gen=M)", f"{f}_NN"]
    assert got["raw"] == (["ra_VB;w_S_PRN"], {False})
    assert got["kraw"] == (sorted(["k_IN;ra_VB;w_S_PRN", "k_IN;h_DEF;ra_VB;w_S_PRN", *unknown("kraw")]), {False})
    assert got["wkfmraw"] == (sorted(["w_CONJ;kfm_TEMP;ra_VB;w_S_PRN", *unknown("wkfmraw")]), {False})
    assert got["bit"] == (["bit_NN", "bit_VB"], {False}) and got["12"] == (["12_CD"], {False})
    assert got["k12"][0].count("k_IN;12_CD") == 1


def test_unknown_forms_and_marks(spark, parts):
    got = analysed(spark, parts, "kq", "kqq", ",", "x")
    assert got["kq"] == (["kq_NN", "kq_NNP(gen=M)"], {True})  # a host of one character has no open reading
    assert got["kqq"] == (sorted(["kqq_NN", "kqq_NNP(gen=M)", *(f"{p};qq_{t}" for p in ("k_IN", "k_IN;h_DEF") for t in ("NN", "NNP(gen=M)"))]), {True})
    assert len(got[","][0]) == 1 and got[","][1] == {False} and got["x"][1] == {True}
    assert lexicon.analyze_morphs(spark.createDataFrame([], "form string"), *parts).collect() == []


def test_prefix_lookup_takes_lengths_from_the_table(spark, parts):
    forms = spark.createDataFrame([("wkfmbit",), ("kbit",)], "form string")
    dictionary = spark.createDataFrame([("bit", "bit", "NN", "")], "form string, lemma string, cpos string, feat_str string")
    assert sorted((r.form, r.prefix, r.host) for r in lexicon.prefix_lookup(forms, parts[1], dictionary).collect()) == [("kbit", "k", "bit"), ("wkfmbit", "wkfm", "bit")]


def test_lattices_share_beginnings(spark, parts):
    tokens = spark.createDataFrame([(1, 1, "kraw"), (1, 2, "bit")], "s int, tok_no int, form string")
    edges = lexicon.token_lattices(tokens, lexicon.analyze_morphs(tokens.select("form"), *parts), ["s"])
    got = sorted((r.tok_no, r.from_node, r.to_node, r.form, r.cpos) for r in edges.collect())
    assert [x[3:] for x in got if x[:2] == (1, 0)] == [("k", "IN"), ("kraw", "NN"), ("kraw", "NNP")]
    top = max(x[2] for x in got if x[0] == 1)
    assert [x[1:] for x in got if x[0] == 2] == [(top, top + 1, "bit", "NN"), (top, top + 1, "bit", "VB")]
    assert ("w", "S_PRN") in {x[3:] for x in got if x[2] == top}


def test_entries_are_learned_from_lattices(spark):
    edges = spark.createDataFrame([(1, 1, 0, 1, "k", "IN"), (1, 1, 1, 2, "bit", "NN"), (1, 2, 2, 3, "q", "X"), (2, 1, 0, 1, "k", "IN"), (2, 1, 1, 2, "bit", "NN")], "s int, tok_no int, from_node int, to_node int, form string, cpos string").selectExpr("*", "'' lemma", "cast(null as string) feat_str")
    raw = spark.createDataFrame([(1, 1, "kbit"), (1, 2, "q"), (2, 1, "kbit")], "s int, tok_no int, form string")
    rows = lexicon.learn_from_lattices(edges, raw, ["s"]).collect()
    assert sorted((r.token, keys([r])[0]) for r in rows) == [("kbit", "k_IN;bit_NN"), ("q", "q_X")]
    with pytest.raises(Exception, match="numbers of tokens differ"):
        lexicon.learn_from_lattices(edges, raw.filter("tok_no = 1"), ["s"]).collect()
