import random

import duckdb
import pytest

from lexloom.llm import quality_rules
from lexloom.llm.queries import op9_quality_rules

COLUMNS = ["doc_id", *quality_rules.STATS, "base_failed", "kept"]


def sql(path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({quality_rules.oracle()})").fetchall(), key=str)


def test_query_matches_sql(spark, sf):
    got = sorted((tuple(r) for r in op9_quality_rules(spark, sf).select(*COLUMNS).collect()), key=str)
    assert got == sql(f"{sf}/documents.parquet")


def test_odd_texts_match_sql(spark, tmp_path):
    r = random.Random(3)
    parts = ["word", "é…", "|", "a!!", "B.", "#*$", "\n", "\n\n", " ", "\t", "All Rights Reserved.", "x x x", "日本。", ".", "»", "\r", "\x0b", "the the the"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.choice([0, 1, 3, 10, 80, 300])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n \n"), (1003, ("one two three four. " * 30 + "\n") * 40)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = sorted((tuple(x) for x in quality_rules.judge(spark.read.parquet(path), keep=["doc_id"]).select(*COLUMNS).collect()), key=str)
    assert got == sql(f"{path}/*.parquet")


def test_prose_with_phrases_and_other_scripts(spark, tmp_path):
    plain = "we walked along the river and spoke of many things that had happened in that long and quiet year "
    lines = [plain + p.decode() + " " + plain for p in quality_rules.BOILERPLATE] + [p.decode().title() + " now" for p in quality_rules.BOILERPLATE]
    lines += ["a blog in our catalog in town.", "ภาษาไทย ไม่มี จุด", "यह एक वाक्य है।", "یہ ایک جملہ ہے۔", "Սա նախադասություն է։", "これは文です。次の文", "no end", "éclick here.", "Click here, read more: sign up."]
    rows = [(i, line if i % 2 else line + "\n" + " ".join([line] * 60)) for i, line in enumerate(lines)]
    rows.append((900, plain * 10 + "click here for more, and " + plain * 3 + "the end."))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    judged = quality_rules.judge(spark.read.parquet(path), keep=["doc_id"])
    assert sorted((tuple(x) for x in judged.select(*COLUMNS).collect()), key=str) == sql(f"{path}/*.parquet")
    assert quality_rules.line_passes(rows[-1][1].encode(), True)
    assert quality_rules.line_passes("यह एक वाक्य है।".encode(), True) and not quality_rules.line_passes(b"Click here, read more: sign up.", True)


def test_cleaning_and_clashing_columns(spark):
    good = "This is a plain sentence of several words, and it ends well. " * 2
    lines = [good + f"Line {i} says more about the number {i * 7}." for i in range(6)]
    text = "\n".join([lines[0], "Home | About | Contact | Help", *lines[1:3], lines[1], "© All rights reserved.", "no end here", *lines[3:], ""])
    docs = spark.createDataFrame([(1, text, "mine", 5), (1, text, "mine", 5), (2, None, None, None)], "doc_id long, text string, kept string, n_words int")
    rows = quality_rules.judge(docs, text="cleaned").orderBy("doc_id").collect()
    assert rows[0] == rows[1] and rows[0].cleaned == "\n".join([*lines, ""]) and rows[0].n_dup_lines == 1 and rows[0].text == text
    assert not rows[2].kept and rows[2].n_words == 0 and rows[2].cleaned == ""
    assert quality_rules.judge(docs.limit(0)).collect() == []


@pytest.mark.parametrize("quality,least", [(1, 0.9)])
def test_clean_documents_stay(spark, quality, least):
    d = "/root/testdata/sf0.01"
    kept = quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"]).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    rows = kept.groupBy("quality").agg({"kept": "count"}).collect()
    share = {q: kept.filter(f"quality = {q} and kept").count() / n for q, n in rows}
    assert share[1] > least and share.get(0, 0) < 0.6
