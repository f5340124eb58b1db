import pytest
import hashlib
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import bpe, token_counts

PATH = bpe.default_vocabulary()
ODD = ["", " ", "\n\n", "a\n\nb", "don't he'll 's", "®'s …'re", "x  y 　z", "née 12a ½b", "<|endoftext|>", "a<|endoftext|>b<|endoftext|><|endoftext|> c", "日本語 テキスト。 𝔘𝔫𝔦", "a" * 5000, " " * 3000 + "x", "\x1c\x1d a\x85b", "é ‍👩‍👧", "<|endoftext", "\r\n \r\n\tq", "''s ''", "£'s€'t"]


@lru_cache
def library(specials):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not specials
    return t


def reference(text):
    t = library(True)
    ids = t.encode(text, add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_fragments_encode_as_the_whole():
    known = bpe.Vocabulary(PATH)
    flat, at = known.encode([t.encode() for t in ODD])
    for i, t in enumerate(ODD):
        ids, back = reference(t)
        assert flat[at[i] : at[i + 1]].tolist() == ids, t[:40]
        assert known.decode(flat[at[i] : at[i + 1]])[0].decode() == back == t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sretlmvd.,<|>endoftx® 　é1")), max_size=40), max_size=4))
def test_any_text(texts):
    known = bpe.vocabulary(PATH)
    flat, at = known.encode([t.encode() for t in texts])
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [reference(t)[0] for t in texts]


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "dé <|endoftext|>", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert all(r.ids == reference(r.text or "")[0] for r in got)
    assert bpe.encode(docs.limit(0)).collect() == []


def test_query(spark, sf):
    from lexloom.llm.queries import op2_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_bpe(spark, sf).collect():
        ids, back = reference(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def count(text):
    return len(library(False).encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é'\n s1®.　", max_size=300), st.lists(st.tuples(st.integers(0, 320), st.integers(0, 60), st.text(alphabet="xy '\né.", max_size=12)), max_size=5))
def test_edited_counts(text, edits):
    known = token_counts.vocabulary(PATH, False)
    chars, tokens = token_counts.build(known, [text.encode()])[0]
    assert tokens[1] == count(text) and chars[1] == len(text)
    tree = (text, chars.tolist(), tokens.tolist())
    for at, removed, inserted in edits:
        a = min(at, len(text))
        want = text[:a] + inserted + text[a + removed :]
        (tree,), _ = token_counts.edit(known, [tree], [(at, removed, inserted)])
        text, chars, tokens = tree
        assert text == want and tokens[1] == count(text) and chars[1] == len(text)


def test_counts_query(spark, sf):
    from lexloom.llm.queries import op1_token_counts

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        n = len(t)
        assert r.n_tokens_before == count(t)
        e = t[: n // 4] + t[10:70] + t[n // 4 :]
        e = e[: n // 2] + e[n // 2 + 37 :]
        e = e[: n + 60] + "\nRevised 2024-05-17." + e[n + 60 :]
        assert r.n_tokens == count(e) and r.n_chars == len(e)
    assert sum(r.n_encoded for r in rows) < sum(r.n_chars for r in rows)


def test_counts_edges(spark):
    rows = [(1, None, None), (2, "", [(0, 0, "abc")]), (3, "a b", [None, (None, 1, None)]), (4, "x <|endoftext|>", [])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    got = {r.doc_id: r for r in token_counts.apply_edits(token_counts.count_tokens(docs)).collect()}
    assert got[1].text is None and got[1].n_tokens == 0
    assert got[2].text == "abc" and got[2].n_tokens == count("abc")
    assert got[3].text == " b" and got[3].n_tokens == count(" b")
    assert got[4].n_tokens == count("x <|endoftext|>")


def test_many_added_tokens_and_apostrophes(spark):
    special = "<|endoftext|>"
    texts = ["it's " + special * 3 + "we'll'x 'tis o''clock" + special, special * 20_000, "x" + special + "'s", "'" * 50 + "a'b'c" * 30, None, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(docs)).collect():
        if texts[r.doc_id] is None or len(r.ids) < 10_000:
            assert r.ids == reference(texts[r.doc_id] or "")[0]
        else:
            assert len(r.ids) == 20_000 and len(set(r.ids)) == 1
        assert r.decoded == (texts[r.doc_id] or "")


def test_other_vocabularies_are_refused(tmp_path):
    import json

    path = tmp_path / "v.json"
    spec = json.load(open(bpe.default_vocabulary(), encoding="utf-8"))
    path.write_text(json.dumps(spec | {"normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError, match="no byte-level BPE"):
        bpe.Vocabulary(str(path))
