

import corpus_pipeline
from lexloom.llm import pii, quality_rules
from tests.llm.test_bpe import reference
from tests.llm.test_ngram_join import brute


def test_stages_match_brute_force(spark):
    """Each stage over what the one before kept, held against plain Python."""
    d = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in source.collect()}
    cleaned = {}
    for i, r in rows.items():
        text = (r.text or "").encode()
        stats = quality_rules.statistics([text])
        out, stay, _ = quality_rules.clean(text)
        if stats["n_words"][0] >= 50 and 100 * stats["n_repeat_words"][0] <= 50 * stats["n_words"][0] and 2 * stay >= stats["word_chars"][0]:
            cleaned[i] = out.decode()
    linked = brute(sorted(cleaned.items()))
    unique = {i: t for i, t in cleaned.items() if linked[i][1] == i}
    model = pii.fit(spark.createDataFrame([(t,) for t in unique.values()], "text string"))
    masked = {}
    for i, t in unique.items():
        spans = [(a, b, k) for k, a, b, ok in pii.candidates(t) if ok or model.score(k, pii.votes(t, k, a, b, ok), pii.traits(t, k, a, b)) >= 0.5]
        for a, b, k in sorted(spans, reverse=True):
            t = f"{t[:a]}<{k.upper()}>{t[b:]}"
        masked[i] = t
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert sorted(got) == sorted(masked)
    for i, r in got.items():
        assert r.ids == reference(masked[i])[0] and r.n_tokens == len(r.ids) and r.source == rows[i].source


def test_each_stage_keeps_columns_and_odd_rows(spark):
    text = " ".join(f"word{i} goes{i} on, and{i} here it{i} ends." for i in range(30))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text + " More.", None, None, None), (None, text, "en", "b", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, "")
            assert out.columns == docs.columns, name
            out.collect()
    assert sorted(str(r.doc_id) for r in corpus_pipeline.quality(spark, docs, "").collect()) == ["1", "1", "2", "None"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["1", "3", "4", "None"]
    assert corpus_pipeline.mixed(spark, docs, "").count() == 6

