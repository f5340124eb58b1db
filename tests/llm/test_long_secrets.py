from lexloom.llm import pii


def test_long_secrets_are_masked_whole(spark):
    secrets = [("Ab3/x+9_Q.-z" * 500)[:n] for n in (40, 201, 1000, 5000)]
    docs = spark.createDataFrame([(i, f"set token={secrets[i % 4]} and go on, line {i}") for i in range(80)], "doc_id long, text string")
    model = pii.fit(docs)
    for r in pii.find(docs, model, redact=True).collect():
        assert r.text == f"set token=<SECRET> and go on, line {r.doc_id}"
        assert [(s.start, s.end) for s in r.spans if s.kind == "secret"] == [(10, 10 + len(secrets[r.doc_id % 4]))]
