"""Nulls, repeated rows, empty tables and very long texts, where the operators' own tests leave them out."""

import corpus_pipeline
from lexloom.llm import bpe, chat_format, quality_classifier, token_counts, url_filters


def test_token_counts_of_odd_rows(spark):
    edits = "array<struct<at: int, removed: int, inserted: string>>"
    long = "some words, and more of them; " * 20_000
    df = spark.createDataFrame([(1, "a b c", [(0, 1, "x")]), (1, "a b c", [(0, 1, "x")]), (2, None, None), (3, long, [(300_000, 5, " new text ")])], f"i int, text string, edits {edits}")
    counted = token_counts.count_tokens(df)
    once = {r.i: r.n_tokens for r in counted.collect()}
    assert counted.count() == 4 and once[2] == 0 and once[3] > 100_000
    after = token_counts.apply_edits(counted).collect()
    assert len(after) == 4 and sorted(r.text for r in after if r.i == 1) == ["x b c"] * 2
    changed = next(r for r in after if r.i == 3)
    want = token_counts.count_tokens(spark.createDataFrame([(changed.text,)], "text string")).first().n_tokens
    assert changed.n_tokens == want and changed.n_encoded < 2000
    empty = token_counts.apply_edits(token_counts.count_tokens(df.filter("false")))
    assert empty.collect() == [] and "n_encoded" in empty.columns


def test_bpe_of_a_long_ordinary_text(spark):
    text = "an ordinary sentence, with commas and 12 numbers. " * 30_000
    ids = bpe.encode(spark.createDataFrame([(text,)], "text string"))
    r = bpe.decode(ids).first()
    one = bpe.encode(spark.createDataFrame([(text[:5000],)], "text string")).first().ids
    assert r.decoded == text and r.ids[: len(one) - 5] == one[:-5] and len(r.ids) > 300_000


def test_quality_of_a_long_text(spark):
    good, bad = "A clean sentence about many things, written with care. ", "click $$$ buy now !!! "
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(80)] + [(1000, good * 20_000), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}
    assert len(got) == 82 and got[1000] > 0.7 and 0 <= got[1001] <= 1


def test_rule_without_a_verdict(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, None)], "page_id int, url string")
    rules = spark.createDataFrame([("a.org", "/x", None), ("org", "/", "block")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect())
    assert got == [(1, "a.org/x", "allow")] * 2 + [(2, None, "allow")]
    assert url_filters.judge(pages.filter("false"), rules).collect() == []


def test_conversation_of_several_chunks(spark):
    n = chat_format.CHUNK * 2 + 100
    turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    part = turns.filter(f"turn < {chat_format.CHUNK + 10}").selectExpr("2L as conv_id", "turn", "role", "text")
    got = chat_format.render(turns.unionByName(part)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(1, n, 1)]
    assert got[0].chat.startswith("<|user|>\nt0<|end|>\n<|assistant|>\nt1<|end|>") and got[0].chat.count("<|end|>") == n


def test_stage_of_quality_rules(spark):
    words = "amber basin cedar delta ember fjord glade harbor inlet jungle kettle lagoon meadow nectar orchard pebble quarry ridge summit thicket".split()
    text = "\n".join("The " + " ".join(words[(i * 7 + k * (i + 3)) % 20] for k in range(9)) + "." for i in range(20))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, None, "en", "s", None), (None, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.quality(spark, docs, "").collect()
    assert [(r.doc_id, r.n_chars) for r in out] == [(1, len(out[0].text))] * 2
    assert corpus_pipeline.quality(spark, docs.filter("false"), "").collect() == []
