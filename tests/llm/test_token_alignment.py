import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexloom.llm import queries, token_alignment

TEXTS = [
    "The cat sat on the mat.", "the cat, the hat", "", None, "  two  spaces \n\n\tand lines ", "▁low line", "<s> <0x41> <|endoftext|> </s>", "日本語 テキスト и кириллица",
    "😀 ok é ﬁ", "x" * 700, "1234567890 " * 3, "a b " * 50, "The cat sat on the mat.", "don't won't 'tis", "\x00 nul", " ", "​zero​width",
]


def _byte_level():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    """The contract token by token, with the libraries on whole texts."""
    a_side, b_side, byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), _byte_level()
    a_side.encode_special_tokens = True
    a_side.no_truncation()
    a_side.no_padding()
    docs = []
    for t in texts:
        a = a_side.encode(" " + (t or ""), add_special_tokens=False).ids
        b = b_side.encode(t or "")
        a_bytes = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + t).encode()}:
            docs.append(([], []))
            continue
        ends = [list(np.cumsum([len(x) for x in side])) for side in (a_bytes, b_bytes)]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            upto = [ends[0].index(end) + 1, ends[1].index(end) + 1]
            groups.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
            at = upto
        docs.append((groups, [(x, y) for p, q in groups for x in p for y in q]))
    count = collections.Counter(pair for _, links in docs for pair in set(links))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for groups, links in docs:
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append(
            (sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")
        )
    return out, count


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("settings", [{}, {"FAN": 2, "FRAME": 7, "PACKED": 50, "RUN_BYTES": 100, "TOGETHER": 5}])
def test_digests_equal_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(token_alignment, name, value)
    df = spark.createDataFrame([(i, t, "own", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string, row int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.weigh(df, keep=["doc_id"]).collect()}
    want, _ = brute(TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == want
    assert want[0] == want[12] and want[5][0] == 0 and want[6][0] > 0


def test_the_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r.text for r in rows])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op12_token_alignment"](spark, sf).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_pair_counts_and_groups(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    want, count = brute(TEXTS)
    rows = token_alignment.pair_counts(df).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in rows} == dict(count)
    assert all(r.best == max(n for (a, _), n in count.items() if a == r.a_id) for r in rows)
    for r in token_alignment.align(spark.createDataFrame(enumerate(TEXTS), "i int, text string"), keep=["i"]).collect():
        a, b, text = iter(r.a_ids), iter(r.b_ids), []
        for g in r.groups:
            text.append(",".join(str(next(a)) for _ in range(g.a)) + "|" + ",".join(str(next(b)) for _ in range(g.b)))
        assert (hashlib.sha256(";".join(text).encode()).hexdigest() if text else "") == want[r.i][-1]
        assert (len(r.a_ids), len(r.b_ids), len(r.groups)) == want[r.i][:3]


def test_merge_adds_numbers_of_equal_keys(monkeypatch):
    monkeypatch.setattr(token_alignment, "FRAME", 3)
    rng = np.random.default_rng(0)
    runs, want = [], collections.Counter()
    for n in (0, 1, 5, 20, 20):
        keys = np.unique(rng.integers(0, 40, n))
        numbers = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), numbers.tolist(), strict=True)))
        runs.append(token_alignment._pack(keys, numbers))
    got = [(k, n) for keys, numbers in token_alignment.merge(runs) for k, n in zip(keys.tolist(), numbers.tolist(), strict=True)]
    assert got == sorted(want.items())


def test_long_text_and_empty_table(spark):
    long = "word another, " * 40_000
    df = spark.createDataFrame([(None, long), (None, long)], "doc_id long, text string")
    one, two = token_alignment.weigh(df).collect()
    assert one == two and one.n_a > 100_000 and one.n_best == one.n_links and one.count_sum == 2 * one.n_links
    empty = token_alignment.weigh(df.filter("false"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", *COLUMNS]
