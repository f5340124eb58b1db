"""Blocks of files are numbered by counts of splits, and sentences go to files and streams without a shuffle of their rows."""

import pytest
from pyspark.sql import functions as F

from lexloom.sources import derived, readers, sinks


@pytest.fixture
def files(spark, tmp_path):
    """Files of many splits, with comments, empty blocks and blocks of comments alone."""
    want = {}
    for name, n in (("a", 400), ("b", 1), ("c", 77)):
        blocks = [f"# {i}\n1\tw{i}\t_\tX\tX\t_\t0\tr\t_\t_\n2\t#\t_\tX\tX\t_\tno\tr\t_\t_" for i in range(n)]
        (tmp_path / name).write_text("\n\n\n\n".join([*blocks, "# end"]) + "\n\n")
        want[name] = [f"w{i}" for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield str(tmp_path), want
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_blocks_are_numbered_across_splits_without_a_shuffle_of_text(spark, files):
    path, want = files
    found = readers.blocks(spark, path)
    assert found.rdd.getNumPartitions() > 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "row_number" not in plan
    rows = readers.conll_rows(found).filter("id = 1").select(F.element_at(F.split("path", "/"), -1).alias("file"), "block", "form").collect()
    for name, forms in want.items():
        assert [r.form for r in sorted((r for r in rows if r.file == name), key=lambda r: r.block)] == forms
        assert sorted(r.block for r in rows if r.file == name) == list(range(1, len(forms) + 1))
    assert readers.blocks(spark, path, strict_terminated=True).count() == sum(map(len, want.values())) + 3
    assert readers.blocks(spark, path, limit=2).count() == 6


def test_sentences_of_files_hold_their_rows(spark, files):
    found = readers.blocks(spark, files[0])
    rows = readers.conll_rows(found).drop("feats")
    nested = readers.conll_sentences(found).select("path", "block", F.inline("rows"))
    assert nested.columns == rows.columns and sorted(map(str, nested.collect())) == sorted(map(str, rows.collect()))
    dep = readers.read_dep(spark, files[0]).drop("line_no")
    within = readers.read_dep_sentences(spark, files[0]).select("path", "block", F.inline("arcs")).drop("place")
    assert sorted(map(str, within.collect())) == sorted(map(str, dep.collect()))


def test_files_of_ranged_sentences_are_in_order(spark, sf, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    s = derived.sentences(derived.documents(spark, sf), ranged=True).select(*derived.SENT, F.concat_ws(" ", "doc_id", "line_no").alias("value"))
    sinks.write_blocks(s, str(tmp_path / "out"), derived.SENT, placed=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [[tuple(map(int, v.split())) for v in p.read_text().split("\n\n") if v] for p in sorted((tmp_path / "out").glob("part-*"))]
    every = [x for p in parts for x in p]
    assert len(parts) > 1 and every == sorted(every) and len(every) == derived.tokens(derived.documents(spark, sf)).select(*derived.SENT).distinct().count()
