"""Jobs over trees, features and lattices shuffle what they need once."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import depgraph, lattice, learn
from lexloom.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feature_strings_need_no_tags_and_lemmas(spark, sf):
    for name in ("b2_format_feats", "b3_host_suffix", "b4_merge_feats"):
        text = plan(catalog.QUERIES[name](spark, sf))
        assert text.count("Aggregate [") == 1 and "regexp_replace" not in text, name


def test_scores_are_summed_without_counting_features_first(spark):
    f = spark.createDataFrame([("a", 0, "x"), ("a", 0, "x"), ("a", 0, "y"), ("a", 1, "z"), ("b", 0, "y")], "form string, candidate int, feature string")
    w = spark.createDataFrame([("x", 2), ("y", 3)], "feature string, w long")
    out = learn.score(f, w, ["form", "candidate"])
    assert plan(out).count("Aggregate [") == 1
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 7), ("a", 1, 0), ("b", 0, 3)]


@pytest.fixture
def planned(spark):
    """Counts exchanges of plans as they are before adaptive changes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def exchanges(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.count("Exchange hashpartitioning") - text.count("ReusedExchange")

    yield exchanges
    spark.conf.set("spark.sql.adaptive.enabled", before)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


EDGES = "s int, tok_no int, from_node int, to_node int, form string, cpos string"


def test_infusion_shuffles_both_sides_once_by_sentence(spark, planned):
    c = spark.createDataFrame([(1, 1, 0, 1, "ab", "W"), (1, 2, 1, 2, "c", "W")], EDGES)
    g = spark.createDataFrame([(1, 1, 0, 1, "a", "P"), (1, 1, 1, 2, "b", "X"), (1, 2, 1, 2, "c", "W")], EDGES)
    out = lattice.infuse_lattices(c, g, ["s"])
    assert planned(out) == 1
    assert sorted((r.tok_no, r.from_node, r.to_node, r.form) for r in out.collect()) == [(1, 0, 1, "a"), (1, 0, 2, "ab"), (1, 1, 2, "b"), (2, 2, 3, "c")]


ARCS = "s int, id int, head int, deprel string"


def test_differing_arcs_take_one_shuffle_and_keep_repeats_and_nulls(spark, planned):
    a = spark.createDataFrame([(1, 1, 0, "r"), (1, 2, 1, "x"), (1, 2, 1, "x"), (1, 2, 1, "x"), (2, 1, None, None), (3, 1, 0, "r")], ARCS)
    b = spark.createDataFrame([(1, 1, 0, "r"), (1, 2, 1, "x"), (2, 1, None, None), (4, 1, 0, "r")], ARCS)
    differ, same = depgraph.diff_arcs(a, b, ["s"]), depgraph.same_arcs(a, b, ["s"])
    assert planned(differ) <= 1 and planned(same) <= 1
    assert sorted((r.s, r.id, r.side) for r in differ.collect()) == [(1, 2, "a"), (1, 2, "a"), (3, 1, "a"), (4, 1, "b")]
    assert sorted((r.s, r.same) for r in same.collect()) == [(1, False), (2, True), (3, False), (4, False)]


def test_lexicon_analysis_learns_its_dictionary_once(spark, sf):
    # the text is read for the forms and for the tokens; the dictionary is a table of its own
    assert plan(catalog.QUERIES["g10_analyze_lexicon"](spark, sf)).count("regexp_extract_all") <= 4
