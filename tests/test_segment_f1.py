"""Segment scores come out of one shuffle of both sides."""

from lexloom.operators import evaluation

SCHEMA = "s int, id int, form string, cpos string"


def test_one_shuffle_repeats_and_missing_sentences(spark):
    gold = spark.createDataFrame([(1, 1, "a", "X"), (1, 2, "a", "X"), (1, 3, "b", None), (2, 1, "c", "Y"), (3, 1, "d", "Y"), (4, 1, "e", None)], SCHEMA)
    pred = spark.createDataFrame([(1, 1, "a", "X"), (1, 2, "a", "Z"), (1, 3, "b", None), (2, 1, "c", "Y"), (4, 1, "e", None), (5, 1, "f", "Y")], SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = evaluation.segment_f1(pred, gold, ["s"], ["id"], {"seg": ["form"], "pos-seg": ["form", "cpos"]})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 1 and "SortMergeJoin" not in plan
        rows = {r.level: (r.gold, r.pred, r.tp, r.em) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert rows == {"seg": (6, 6, 5, 0.4), "pos-seg": (6, 6, 4, 0.4)}
