"""Values of forms come to tokens by slices of documents; what follows stays within a slice."""

import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators import evaluation, lattice, lexicon
from lexloom.plans import catalog
from lexloom.sources import derived

S = derived.SLICE


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "en", "a b - a\n\n b"), (S - 1, "en", "b"), (S, "en", "a - c"), (3 * S, None, None), (5, "en", ""), (0, "de", "a b")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def words(docs):
    return [(r.doc_id, n, k, w) for r in docs.collect() if r.text is not None for n, line in enumerate(r.text.split("\n"), 1) for k, w in enumerate(re.findall("[^\x20\x09-\x0d]+", line), 1)]


def test_values_come_to_every_token_of_their_form(docs):
    forms = derived.slice_forms(docs)
    assert {r.form: (r.n, sorted(r.slices)) for r in forms.collect()} == {"a": (4, [0, 1]), "b": (4, [0]), "-": (2, [0, 1]), "c": (1, [1])}
    given = forms.filter("form <> 'b'").select("slices", F.col("form").alias("token"), F.upper("form").alias("value"))
    got = sorted((r.doc_id, r.line_no, r.tok_no, r.token, r.value) for r in derived.slice_tokens(docs, given).collect())
    assert got == sorted((*w, None if w[3] == "b" else w[3].upper()) for w in words(docs))


def test_rows_of_tokens_are_renumbered_as_edges_are(spark, docs):
    token = [(1, 2, [(1, 3, "x"), (1, 2, "y"), (2, 3, "z")]), (1, 1, [(0, 4, "w")]), (2, 1, [(5, 6, "v")])]
    rows = spark.createDataFrame(token, "s int, tok_no int, edges array<struct<from_node: int, to_node: int, form: string>>")
    flat = lambda df: sorted(map(tuple, df.select("s", "tok_no", "from_node", "to_node", "form").collect()))
    assert flat(lattice.renumber_rows(rows, ["s"]).select("s", "tok_no", F.inline("edges"))) == flat(lattice.renumber(rows.select("s", "tok_no", F.inline("edges")), ["s"]))


def test_scores_within_a_row_are_those_of_the_join(spark):
    both = [(1, ["a", "b", "a"], ["a"]), (2, ["a"], ["a", "c"]), (3, ["x"], ["y"]), (4, ["q"], ["q"])]
    rows = spark.createDataFrame(both, "t int, p array<string>, g array<string>")
    side = lambda c: rows.select("t", F.explode(c).alias("k"))
    want = evaluation.morph_scores(side("p"), side("g"), ["t"], F.col("k"))
    got = evaluation.morph_scores_within(rows, F.col("p"), F.col("g")).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes


def test_entries_are_learned_from_rows(spark):
    edge = "array<struct<from_node: int, to_node: int, form: string, lemma: string, cpos: string, feat_str: string>>"
    rows = spark.createDataFrame([("kb", [(1, 2, "b", "", "NN", None), (0, 1, "k", "", "IN", "")])] * 2 + [("q", [(2, 3, "q", "", "X", "")])], f"token string, edges {edge}")
    got = {r.token: [(m.form, m.cpos, m.feat_str) for m in r.morphs] for r in lexicon.learn_from_rows(rows, "token", "edges").collect()}
    assert got == {"kb": [("k", "IN", ""), ("b", "NN", "")], "q": [("q", "X", "")]}
    for bad in ([("kb", None)], [(None, [(0, 1, "k", "", "IN", "")])]):
        with pytest.raises(Exception, match="numbers of tokens differ"):
            lexicon.learn_from_rows(spark.createDataFrame(bad, rows.schema), "token", "edges").collect()


def shuffles(df):
    """What the plan's exchanges are dealt by, one without a number of partitions for each."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange \w+\(([^()]*?), \d+\)", plan)]


@pytest.mark.parametrize("name", ["a8_errors_by_class", "a1_entries_from_lattices", "g10_chain_lattices"])
def test_tokens_are_shuffled_by_slice_alone(spark, sf, name):
    by = shuffles(catalog.QUERIES[name](spark, sf))
    assert "slice" in by and not [x for x in by if "line_no" in x or "tok_no" in x]


def test_lattices_of_rows_are_those_that_are_built(spark):
    m = lambda *p: [(f, "", c, "") for f, c in p]
    sets = [("kbit", [m(("k", "IN"), ("bit", "NN")), m(("k", "IN"), ("h", "DEF"), ("bit", "NN")), m(("k", "IN"), ("bit", "VB")), m(("kbit", "NN"))], False), ("q", [m(("q", "X"))], True)]
    rows = spark.createDataFrame(sets, "form string, analyses array<array<struct<form: string, lemma: string, cpos: string, feat_str: string>>>, oov boolean")
    named = rows.select(F.col("form").alias("token"), F.explode("analyses").alias("morphs"))
    columns = ["token", "from_node", "to_node", "form", "cpos", "lemma", "feat_str"]
    got = lexicon.row_lattices(rows).select("token", F.inline("edges")).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, lattice.build(named, ["token"], ["lemma", "feat_str"]).select(columns).collect()))


def test_entries_of_a_form_stay_in_its_row(spark):
    entries = spark.createDataFrame([("a", [("a", None, "NN", "")]), ("a", [("a", "", "VB", "")]), ("z", [("z", "", "X", "")])], "token string, morphs array<struct<form: string, lemma: string, cpos: string, feat_str: string>>")
    args = spark.createDataFrame([("a",), ("b",)], "form string"), entries, spark.createDataFrame([("NN|NN|gen=M|num=S",), ("X|X|",)], "oov_msr string")
    flat = lambda df: sorted((r.form, r.oov, [tuple(m) for m in r.morphs]) for r in df.collect())
    assert flat(lexicon.entry_morph_sets(*args).select("form", F.explode("analyses").alias("morphs"), "oov")) == flat(lexicon.entry_morphs(*args))


def test_each_shape_of_links_is_searched_once(spark, sf):
    plan = catalog.QUERIES["g5_meet_join"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    searched = next(x for x in plan.split("Aggregate [")[1:] if "collect_set" in x)
    assert searched.startswith("shape#"), searched[:80]
