"""Sentences that are one row each go to corpus files without a shuffle of their morphemes."""

from pyspark.sql import functions as F

from lexloom.operators import depgraph
from lexloom.plans import catalog
from lexloom.sources import derived, sinks

DOCS = [(1, "a b\n\n _ c", "en"), (None, "x y", "en"), (1, "d\ne", "fr"), (2, None, "en"), (3, " \n\t", "en"), (4, "zu 2 !", None)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_of_rows_equal_those_of_tokens(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    whole = lambda df: df.withColumns({"lemma": F.lit(""), "pos": F.col("cpos"), "feat_str": F.lit("_")})
    want = sinks.conll_lines(depgraph.to_conll(whole(derived.arcs(docs)), derived.SENT), derived.SENT)
    for ranged in (False, True):
        g = derived.sentence_arcs(docs, ranged).withColumn("arcs", F.transform("arcs", lambda t: t.withField("lemma", F.lit("")).withField("pos", t["cpos"]).withField("feat_str", F.lit("_"))))
        got = sinks.conll_lines(depgraph.to_conll(g, derived.SENT, within="arcs"), derived.SENT, "arcs")
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_lines_of_trees_collect_no_tokens(spark, sf):
    for name in ("k2_conll_lines", "p16_to_conll"):
        text = plan(catalog.QUERIES[name](spark, sf))
        assert "collect_list(line" in text and text.count("collect_list") == 1 and text.count("Generate posexplode") == 1, name


def test_equal_rows_are_counted_before_they_are_converted(spark, sf):
    plan = catalog.QUERIES["p16_from_conll"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.rindex("Aggregate [form")], plan[plan.rindex("Aggregate [form") :].split("\n", 1)[1]
    assert above and "map_from_arrays" not in below


def test_candidate_paths_are_made_without_a_join(spark, sf):
    from lexloom.plans import tree_queries as tq

    rows = tq._slice_rows(spark, sf)
    plan = tq.path_candidates(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") == rows._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") + rows._jdf.queryExecution().executedPlan().toString().count("HashJoin")
    one = tq.path_candidates(rows).groupBy(*tq.TOKEN).agg(F.count_if("gold").alias("n"), F.max_by("gold", "path_id").alias("last")).filter("n <> 1 or not last")
    assert one.count() == 0
