"""Corpus files to tables. A sentence is a block of lines between blank lines; blocks are read by Spark's text source.

Every reader gives (path, block, ...) with block numbered from 1 in the order of the file. Blocks that are
empty after CRs and outer line breaks are removed don't count; a last block without a blank line after it
counts unless strict_terminated is set. Rows that don't parse are kept with their text in _corrupt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import from_underscore, parse_feats, parse_int, parse_msr, parse_msr_suffix, universal_feats, universal_tag


def blocks(spark: SparkSession, path: str, limit: int | None = None, strict_terminated: bool = False) -> DataFrame:
    """path, block, lines. Files are numbered apart, each in its own order of splits and rows."""
    raw = spark.read.text(path, lineSep="\n\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace("value", "\r", "").alias("value"))
    rows = numbered(raw.select("path", "at", F.regexp_replace("value", r"^\n+|\n+$", "").alias("text")).filter("text <> ''"))
    if strict_terminated:
        # the text source gives no terminator back: the file's last block counts if the file ends in a blank line
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.endswith("value", F.lit("\n\n")).alias("closed"))
        rows = rows.join(F.broadcast(whole), "path").filter("block < n_blocks or closed")
    out = rows.select("path", "block", F.split("text", "\n").alias("lines"))
    return out.filter(F.col("block") <= limit) if limit else out


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of files (path, at: where the split of the file begins), as a text source gives them -> the same with block, from 1 in the order of the file, and n_blocks of the file.

    A split's rows are read in a row, and reading the files again gives them the same running numbers. So only splits are counted and ordered, one row each, and no text is shuffled."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    splits = rows.groupBy("path", "at").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy("path")
    before = F.coalesce(F.sum("_n").over(of.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "at", (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(of).cast("int").alias("n_blocks"))
    return rows.join(F.broadcast(splits), ["path", "at"]).withColumn("block", (F.col("_row") + F.col("_shift")).cast("int")).drop("_row", "_shift")


def read_tokens(spark: SparkSession, path: str, limit: int | None = None, strict_terminated: bool = False) -> DataFrame:
    """path, block, tok_no, form: one token a line."""
    return blocks(spark, path, limit, strict_terminated).select("path", "block", F.posexplode("lines").alias("i", "form")).select("path", "block", (F.col("i") + 1).alias("tok_no"), "form")


def _rows(found: DataFrame) -> DataFrame:
    """path, block, line_no, comment lines left out, line and cells."""
    return found.select("path", "block", F.posexplode("lines").alias("line_no", "line")).filter("not startswith(line, '#')").withColumn("cells", F.split("line", "\t"))


def _cell(i: int, cells: Column | str = "cells") -> Column:
    return from_underscore(F.get(cells, F.lit(i)))


def _within(found: DataFrame, row: Callable[[Column, Column], Column]) -> Column:
    """The rows of a block as an array: row makes a struct of a line's cells and the line; comment lines are left out."""
    return F.transform(F.filter("lines", lambda x: ~F.startswith(x, F.lit("#"))), lambda x: F.transform(F.array(F.split(x, "\t")), lambda c: row(c, x))[0])


def read_conll(spark: SparkSession, path: str, limit: int | None = None, strict_terminated: bool = False) -> DataFrame:
    """Ten-column dependency rows (S2): id, form, lemma, cpos, pos, feats, feat_str, head, deprel, _corrupt."""
    return conll_rows(blocks(spark, path, limit, strict_terminated))


def _conll_row(cells: Column, line: Column) -> list[Column]:
    at = lambda i: parse_int(F.get(cells, F.lit(i)))
    text = {name: _cell(i, cells) for i, name in ((1, "form"), (2, "lemma"), (3, "cpos"), (4, "pos"), (7, "deprel"))}
    ok = (F.size(cells) == 10) & (text["form"] != "") & (text["cpos"] != "") & (text["pos"] != "") & (text["deprel"] != "") & at(0).isNotNull() & at(6).isNotNull()
    feat = F.get(cells, F.lit(5))
    return [at(0).alias("id"), *(text[c].alias(c) for c in ("form", "lemma", "cpos", "pos")), parse_feats(feat).alias("feats"), feat.alias("feat_str"), at(6).alias("head"), text["deprel"].alias("deprel"), F.when(~F.coalesce(ok, F.lit(False)), line).alias("_corrupt")]


def conll_rows(found: DataFrame) -> DataFrame:
    """The rows of blocks (path, block, lines), row by row: also for streams."""
    return _rows(found).select("path", "block", *_conll_row(F.col("cells"), F.col("line")))


def conll_sentences(found: DataFrame) -> DataFrame:
    """Blocks (path, block, lines) -> path, block, rows: the columns of conll_rows but feats, one row a sentence; blocks of comments alone have none."""
    row = lambda cells, line: F.struct(*(c for c in _conll_row(cells, line)[:5] + _conll_row(cells, line)[6:]))
    return found.select("path", "block", _within(found, row).alias("rows")).filter("size(rows) > 0")


def read_conllu(spark: SparkSession, path: str, limit: int | None = None, strict_terminated: bool = False) -> DataFrame:
    """Ten-column universal rows (S3): as read_conll with upos, xpos, deps, misc and tok_no, the running count of tokens; a-b rows give their
    token's form to the rows in their range, a.b rows are left out; comments are in sentence_comments()."""
    return conllu_rows(blocks(spark, path, limit, strict_terminated))


def conllu_rows(found: DataFrame) -> DataFrame:
    """The rows of blocks (path, block, lines; path and block name a sentence)."""
    rows = _rows(found.repartition("path", "block")).withColumn("key", F.get("cells", F.lit(0))).filter("not contains(key, '.')")
    by = Window.partitionBy("path", "block").orderBy("line_no")
    span = F.contains("key", F.lit("-"))
    rows = rows.withColumn("span_end", F.when(span, F.substring_index("key", "-", -1).try_cast("int"))).withColumn("span_form", F.when(span, F.get("cells", F.lit(1))))
    last = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open_end", F.last("span_end", True).over(last)).withColumn("open_form", F.last("span_form", True).over(last))
    inside = ~span & (F.col("key").try_cast("int") <= F.col("open_end"))
    rows = rows.withColumn("begins", F.when(span | ~F.coalesce(inside, F.lit(False)), F.lit(1)).otherwise(F.lit(0))).withColumn("tok_no", F.sum("begins").over(last)).filter(~F.contains("key", F.lit("-")))
    feat = F.get("cells", F.lit(5))
    return rows.select("path", "block", parse_int("key").alias("id"), _cell(1).alias("form"), _cell(2).alias("lemma"), _cell(3).alias("upos"), _cell(4).alias("xpos"), parse_feats(feat).alias("feats"), feat.alias("feat_str"), parse_int(F.get("cells", F.lit(6))).alias("head"), _cell(7).alias("deprel"), F.filter(F.split(_cell(8), r"\|"), lambda d: d != "").alias("deps"), _cell(9).alias("misc"), "tok_no", F.when(F.coalesce(inside, F.lit(False)), F.col("open_form")).otherwise(_cell(1)).alias("token"), F.when((F.size("cells") != 10) | parse_int("key").isNull(), F.col("line")).alias("_corrupt"))


def sentence_comments(spark: SparkSession, path: str) -> DataFrame:
    """path, block, comments: the lines of each sentence that begin with #."""
    return blocks(spark, path).select("path", "block", F.filter("lines", lambda x: F.startswith(x, F.lit("#"))).alias("comments"))


def read_lattice(spark: SparkSession, path: str, fmt: str = "spmrl", limit: int | None = None, strict_terminated: bool = False) -> DataFrame:
    """Lattice edges: from_node, to_node, form, lemma, cpos, pos, feats, feat_str, tok_no, token (S4, S5, S6). An edge that ends where it starts ends one later.

    fmt spmrl: eight columns. ul: spans `from-to` give tokens, edges belong to the span they lie in, or without spans to a running token by their bounds. ud: the
    tokens are the words of the sentence's comment, an edge's token is in column nine."""
    return lattice_rows(blocks(spark, path, limit, strict_terminated), fmt)


def _lattice_row(cells: Column) -> list[Column]:
    at = lambda i: parse_int(F.get(cells, F.lit(i)))
    feat = F.get(cells, F.lit(6))
    return [at(0).alias("from_node"), F.when(at(0) == at(1), at(1) + 1).otherwise(at(1)).alias("to_node"), _cell(2, cells).alias("form"), _cell(3, cells).alias("lemma"), _cell(4, cells).alias("cpos"), _cell(5, cells).alias("pos"), parse_feats(feat, "lattice").alias("feats"), feat.alias("feat_str")]


def lattice_sentences(found: DataFrame) -> DataFrame:
    """Blocks (path, block, lines) in eight columns -> path, block, edges: from_node, to_node, form, lemma, cpos, pos, feat_str and tok_no of lattice_rows, one row a sentence; blocks of comments alone have none."""
    row = lambda cells, line: F.struct(*(c for n, c in enumerate(_lattice_row(cells)) if n != 6), parse_int(F.get(cells, F.lit(7))).alias("tok_no"))
    return found.select("path", "block", _within(found, row).alias("edges")).filter("size(edges) > 0")


def lattice_rows(found: DataFrame, fmt: str = "spmrl") -> DataFrame:
    """The edges of blocks (path, block, lines; path and block name a sentence). spmrl goes row by row: also for streams."""
    rows = _rows(found.repartition("path", "block") if fmt == "ul" else found)
    at = lambda i: parse_int(F.get("cells", F.lit(i)))
    base = _lattice_row(F.col("cells"))
    if fmt == "spmrl":
        return rows.select("path", "block", *base, at(7).alias("tok_no"), F.lit(None).cast("string").alias("token"))
    if fmt == "ud":
        # words of a block's first comment are looked up within the block
        words = F.expr("split(trim(substring(filter(lines, x -> startswith(x, '#'))[0], 2)), ' +')")
        edge = lambda w, c, x: F.struct(x.alias("line"), F.get(w, parse_int(F.get(c, F.lit(8))) - 1).alias("token"))
        each = F.transform(F.array(words), lambda w: _within(found, lambda c, x: edge(w, c, x)))[0]
        rows = found.select("path", "block", F.inline(each)).withColumn("cells", F.split("line", "\t"))
        return rows.select("path", "block", *base, at(8).alias("tok_no"), "token")
    # spans are numbered, and each edge looks back to the last span that starts at or before it: one sort of the sentence
    key = F.get("cells", F.lit(0))
    by = Window.partitionBy("path", "block")
    start, end = (F.substring_index(key, "-", n).try_cast("int") for n in (1, -1))
    rows = rows.withColumn("is_span", F.contains(key, F.lit("-"))).withColumn("at", F.when(F.col("is_span"), start).otherwise(at(0)))
    rows = rows.withColumn("spans", F.count_if("is_span").over(by)).withColumn("n", F.count_if("is_span").over(by.orderBy("at", F.desc("is_span"), "line_no").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("is_span"), F.struct(end.alias("e"), F.get("cells", F.lit(1)).alias("token"))), True).over(by.orderBy("at", F.desc("is_span"), "line_no").rowsBetween(Window.unboundedPreceding, 0))
    edges = rows.withColumn("last", last).filter("not is_span").select("path", "block", *base, "spans", F.when(F.col("spans") > 0, F.col("n")).alias("tok_no"), F.col("last.e").alias("e"), F.col("last.token").alias("token"))
    inside = edges.filter("spans = 0 or to_node <= e")
    before = F.max("to_node").over(Window.partitionBy("path", "block").orderBy("from_node", "to_node").rowsBetween(Window.unboundedPreceding, -1))
    starts = inside.withColumn("new", F.when(F.coalesce(before <= F.col("from_node"), F.lit(True)), F.lit(1)).otherwise(F.lit(0)))
    running = F.sum("new").over(Window.partitionBy("path", "block").orderBy("from_node", "to_node").rowsBetween(Window.unboundedPreceding, 0))
    return starts.withColumn("run", running).select("path", "block", "from_node", "to_node", "form", "lemma", "cpos", "pos", "feats", "feat_str", F.coalesce("tok_no", "run").cast("int").alias("tok_no"), "token")


def read_lexicon(spark: SparkSession, path: str, tagset: str = "source", decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines `token (msr lemma)*` (S7, S8): token, analysis_id, tag, feat_str, lemma, suffix (bridge, form, feat_str), suffix_code, definite (the prefix is DEF); UNK analyses go; lines of one token are one entry.

    An msr is `prefix:host:suffix`, its codes after -. tagset universal converts tags and features. decode (E3) makes an array of
    struct(msr, lemma) of a line instead."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select("value", F.split("value", " +").alias("p"))
    pairs = decode(F.col("value")) if decode else F.expr("transform(sequence(0, cast(size(p) / 2 as int) - 1), i -> struct(p[2 * i + 1] as msr, p[2 * i + 2] as lemma))")
    rows = lines.filter("size(p) > 2").select(F.col("p")[0].alias("token"), F.explode(F.array_distinct(pairs)).alias("a")).distinct().select("token", "a.msr", "a.lemma").withColumn("parts", F.split("msr", ":"))
    host = parse_msr(F.coalesce(F.get("parts", F.lit(1)), F.lit("")))
    rows = rows.withColumn("host", host).filter("host.tag <> 'UNK'")
    suffix = F.coalesce(F.get("parts", F.lit(2)), F.lit(""))
    tag, feats = F.col("host.tag"), F.col("host.feat_str")
    if tagset == "universal":
        converted = F.split(universal_tag(tag), "-", 2)
        own = F.coalesce(F.get(converted, F.lit(1)), F.lit(""))
        other = F.when(feats != "", universal_feats(feats)).otherwise(F.lit(""))
        feats = F.array_join(F.array_sort(F.filter(F.concat(F.split(own, r"\|"), F.split(other, r"\|")), lambda x: x != "")), "|")
        tag = converted[0]
    out = rows.select("token", tag.alias("tag"), feats.alias("feat_str"), "lemma", F.when(suffix != "", parse_msr_suffix(F.col("host.tag"), suffix)).alias("suffix"), suffix.alias("suffix_code"), (F.col("parts")[0] == "DEF").alias("definite"))
    return out.withColumn("analysis_id", F.row_number().over(Window.partitionBy("token").orderBy("tag", "feat_str", "lemma")))


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """Lines `token (forms tags)*` with forms parted by ^ and tags by + (S7): prefix, analysis_id, morphs (array of form, cpos)."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select(F.split("value", " +").alias("p")).filter("size(p) > 2")
    pairs = F.expr("transform(sequence(0, cast(size(p) / 2 as int) - 1), i -> struct(p[2 * i + 1] as forms, p[2 * i + 2] as tags))")
    rows = lines.select(F.col("p")[0].alias("prefix"), F.posexplode(pairs).alias("i", "a"))
    tags = F.split(F.regexp_replace("a.tags", ":+$", ""), r"\+")
    morphs = F.zip_with(F.split("a.forms", r"\^"), tags, lambda f, t: F.struct(f.alias("form"), F.regexp_replace(t, ":", "").alias("cpos")))
    return rows.select("prefix", (F.col("i") + 1).alias("analysis_id"), morphs.alias("morphs"))


def read_ud_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab lines `token, form, lemma, cpos, pos, features`; lines with an empty token go on with the entry above (S9): token, analysis_id, morphs."""
    rows = spark.read.text(path).filter("value <> ''").select(F.monotonically_increasing_id().alias("i"), F.col("_metadata.file_path").alias("path"), F.split("value", "\t").alias("c"))
    entry = F.count_if(F.col("c")[0] != "").over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("analysis", entry)
    morph = F.struct("i", F.col("c")[1].alias("form"), F.col("c")[2].alias("lemma"), F.col("c")[3].alias("cpos"), F.col("c")[4].alias("pos"), F.col("c")[5].alias("feat_str"))
    out = rows.groupBy("path", "analysis").agg(F.max(F.when(F.col("c")[0] != "", F.col("c")[0])).alias("token"), F.array_sort(F.collect_list(morph)).alias("morphs"))
    return out.select("token", F.row_number().over(Window.partitionBy("token").orderBy("path", "analysis")).alias("analysis_id"), F.transform("morphs", lambda m: m.dropFields("i")).alias("morphs"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A learned dictionary."""
    return spark.read.parquet(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """value: lines that are neither empty nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")


def _dep_row(cells: Column, width: int) -> list[Column]:
    form, tag, head, label = (0, 1, 2, 3) if width == 4 else (1, 3, 6, 7)
    at = parse_int(F.get(cells, F.lit(head)))
    return [_cell(form, cells).alias("form"), _cell(tag, cells).alias("cpos"), (at if width == 4 else at - 1).alias("head"), _cell(label, cells).alias("deprel")]


def read_dep(spark: SparkSession, path: str, width: int = 10) -> DataFrame:
    """path, block, form, cpos, head (from 0, -1 for the root), deprel, of ten-column blocks, or of those four columns with such heads."""
    return _rows(blocks(spark, path)).select("path", "block", "line_no", *_dep_row(F.col("cells"), width))


def read_dep_sentences(spark: SparkSession, path: str, width: int = 10) -> DataFrame:
    """path, block, arcs: the rows of read_dep in order (place, form, cpos, head, deprel), one row a sentence. Blocks come as the files have them."""
    found = blocks(spark, path)
    rows = F.transform(_within(found, lambda cells, line: F.struct(*_dep_row(cells, width))), lambda r, i: F.struct(i.alias("place"), *(r[c].alias(c) for c in ("form", "cpos", "head", "deprel"))))
    return found.select("path", "block", rows.alias("arcs"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """feature, w."""
    return spark.read.parquet(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """path, md5 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
