import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        odd, even = d[::-1][::2], d[::-1][1::2]
        return 16 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"a1@.+-() %é_,\n", "b.c", "@x.y", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.255", "0300.1", "user@mail.example.com"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert [(k, a, b) for k, a, b, ok in pii.candidates(text) if ok] == base(text)


def test_query(spark, sf):
    from lexloom.llm.queries import op5_pii

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op5_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS[:4]]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_model_and_redaction(spark):
    rows = [(i, f"call {i} now: phone +1 (212) 555-0{i:03d} or mail a{i}@mail.example.com, ssn 123-45-6{i:03d} key AKIAABCDEFGHIJKLM{i:03d}.", "x") for i in range(100, 160)]
    rows += [(1, None, "y"), (2, "", "y"), (3, "version 1.2.3.999 page 000-00-0000", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.find(docs, model, redact=True).collect()}
    assert got[1].text is None and got[1].spans == [] and got[2].text == ""
    assert got[100].text == "call 100 now: phone <PHONE> or mail <EMAIL>, ssn <ID> key <SECRET>."
    assert "<IP>" not in got[3].text and "<ID>" not in got[3].text
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).collect() == []
