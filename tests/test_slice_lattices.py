"""Lattices are made in the rows of tokens, which numbers of paths come to by slices, and written from there."""

import pytest
from pyspark.sql import functions as F

from lexloom.plans import catalog, tree_queries
from lexloom.sources import derived, readers, sinks
from tests.test_slices import shuffles

SENT = ["s"]
EDGE = "from_node: int, to_node: int, form: string, lemma: string, cpos: string, pos: string, feat_str: string"


@pytest.fixture(scope="module")
def rows(spark):
    e = lambda a, b, f, c="X": (a, b, f, "", c, c, "_")
    found = [(1, 2, "q", False, [e(2, 4, "q", "Y")]), (1, 1, "ab", True, [e(1, 2, "b"), e(0, 2, "ab"), e(0, 1, "a", "PREFIX")]), (2, 1, "_", False, [e(0, 2, "_")])]
    return spark.createDataFrame(found, f"s int, tok_no int, token string, oov boolean, edges array<struct<{EDGE}>>")


def text(df):
    return sorted((r.s, r.value) for r in df.collect())


def test_lines_of_rows_are_those_of_edges(rows):
    edges = rows.select("s", "tok_no", "token", "oov", F.inline("edges"))
    assert text(sinks.lattice_lines_of_rows(rows, SENT, "edges")) == text(sinks.lattice_lines(edges, SENT))
    assert text(sinks.ud_lattice_lines_of_rows(rows, SENT, "edges")) == text(sinks.ud_lattice_lines(edges, SENT))
    plain = sinks.ud_lattice_lines(edges, SENT, tag="T", spans=False)
    assert text(sinks.ud_lattice_lines_of_rows(rows, SENT, "edges", tag="T", spans=False)) == text(plain)
    assert text(sinks.ud_lattice_lines_of_rows(rows, SENT, "edges", tag="T", spans=False, comment=True)) == text(sinks.commented(plain, edges, SENT))
    token = ["s", "tok_no"]
    assert sorted(map(tuple, sinks.json_lattice_of_rows(rows, token, "edges").collect())) == sorted(map(tuple, sinks.json_lattice(edges, token).collect()))


def test_morphemes_of_rows_are_numbered_along_the_sentence(rows):
    gold = rows.withColumn("morphs", F.expr("transform(if(size(edges) > 1, array(edges[2], edges[0]), edges), m -> struct(m.from_node, m.form, m.lemma, m.cpos as upos, '_' as xpos, '_' as feat_str, 0 as head, 'r' as deprel))"))
    one = gold.select("s", "tok_no", "token", F.inline("morphs"))
    ids = one.withColumn("id", F.expr("row_number() over (partition by s order by tok_no, from_node)"))
    assert text(sinks.conllu_lines_of_rows(gold, SENT, "morphs")) == text(sinks.conllu_lines(ids, SENT))
    assert text(sinks.segmentation_lines_of_rows(gold, SENT, "morphs")) == text(sinks.segmentation_lines(one, SENT))


def test_numbers_of_paths_give_the_paths_of_forms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    flat = lambda df: sorted(map(str, df.select("token", "paths").collect()))
    forms = derived.slice_forms(docs)
    got = derived.split_numbers(forms).select("token", derived.paths_of(F.col("token"), F.col("value")).alias("paths"))
    want = derived.form_paths(derived.distinct_forms(derived.tokens(docs)))
    assert flat(got) == flat(want.filter("size(paths) > 1"))
    assert flat(want.filter("size(paths) = 1")) == flat(want.filter("size(paths) = 1").select("token", derived.paths_of(F.col("token"), F.lit(None).cast("array<int>")).alias("paths")))


def test_sentences_of_lattice_files_have_the_rows_of_edges(spark, tmp_path):
    (tmp_path / "x").write_text("# c\n0\t1\ta\t_\tX\tX\t_\t1\n1\t1\tb\t_\tY\tY\tg=F\t2\n\n# c alone\n\n0\tz\n")
    found = readers.blocks(spark, str(tmp_path / "x"))
    columns = ["block", "from_node", "to_node", "form", "lemma", "cpos", "pos", "feat_str", "tok_no"]
    got = readers.lattice_sentences(found).select("block", F.inline("edges")).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, readers.lattice_rows(found).select(columns).collect()))


def test_all_edges_are_written(spark, sf):
    lines = catalog.QUERIES["k4_lattice_lines"](spark, sf)
    n = lines.select(F.sum(F.size(F.split("value", "\n"))).alias("n")).first().n
    assert n == tree_queries._edges(spark, sf).count() > tree_queries._tokens(spark, sf).count()


@pytest.mark.parametrize("name", ["k4_lattice_lines", "k5_a25_span_lines", "k6_json_lattice", "k7_segmentation", "b19_same_paths", "j17_repair_fused_h"])
def test_tokens_are_shuffled_by_slice_alone(spark, sf, name):
    by = shuffles(catalog.QUERIES[name](spark, sf))
    assert "slice" in by and not [x for x in by if "line_no" in x or "tok_no" in x or "doc_id" in x]


@pytest.mark.parametrize("name", ["s3_k3_conllu_files", "s4_k4_lattice_files", "s5_k5_span_files", "s6_k5_comment_files"])
def test_lattice_files_are_packed(spark, sf, name):
    files = catalog.QUERIES[name](spark, sf).inputFiles()
    assert files and all(f.endswith(".gz") for f in files)
