import random
import re

import numpy as np
import pytest

from lexloom.llm import ngram_join
from lexloom.llm._text import shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, k=5):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    shared = [r.choice(vocabulary) for _ in range(60)]
    for length in (1, 3, 5, 6, 8, 9, 12, 20, 40, 90, 200, 400):
        base = [r.choice(vocabulary) for _ in range(length)]
        for c in range(12):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, length // 20])):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [r.choice(vocabulary)], [w[at], r.choice(vocabulary)]])
                w = w or ["x"]
            if c % 4 == 0:
                w += shared[: r.choice([0, 20, 60])]
            rows.append((n, " ".join(w).title() if c % 3 == 0 else "\n".join(w)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = [*near_copies(seed), (9000, None), (9001, ""), (9002, " \t\n"), (9003, "a"), (9004, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(5, "one two three four five six", "x"), (5, "one two three four five six", "x"), (None, "one two three four five six", "y"), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).select("n_shingles", "component_id").fillna(-1).collect())
    assert got == [(0, 7), (2, -1), (2, 5), (2, 5)]
    assert ngram_join.jaccard_components(docs.limit(0)).collect() == []


def test_any_linked_pair_shares_a_name():
    """At any tier: the names of two sets meet whenever the sets link, more than e of them where one set is not short."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [*range(1, 40), 60, 100, 250]:
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for cut in range(4):
            keep = base[rng.permutation(n)[: max(1, n - cut * n // 12)]]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 1 + n // 9)).astype(np.uint64)])))
    name, place, short = ngram_join.signatures(sets, 80, 100)
    held = [set(name[place == i].tolist()) for i in range(len(sets))]
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                links += 1
                both = held[i] & held[j]
                enough = False
                for f in {x & 63 for x in both}:
                    e = int(ngram_join.spare(np.array([f]))[0])
                    n = sum(x & 63 == f for x in both)
                    enough |= n >= (1 if short[i] >> f & 1 and short[j] >> f & 1 else e + 1)
                assert enough
    assert links > 50


def test_passages_that_many_documents_share(spark):
    """A passage with very many holders: links of the documents that hold it are still found."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = some(40), []
    for i in range(0, 270, 3):
        own = some(r.choice([4, 20, 60, 200]))
        rows += [(i, " ".join(own[:3] + passage + own[3:])), (i + 1, " ".join(own[:3] + passage + own[3:-1] + ["x"]))]
        rows.append((i + 2, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_texts_under_one_id_are_sets_of_their_own(spark):
    r = random.Random(4)
    a, b = (" ".join(r.choice("abcdefghij") + str(r.random()) for _ in range(40)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a), (9, b)]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (9, 1)]
    assert len({r.group_id for r in out if r.group_id is not None}) == 2
    text_ids = spark.createDataFrame([("1", a), ("x", a), ("2", a)], "doc_id string, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.jaccard_components(text_ids).collect()) == [(0, 0), (1, 1), (2, 1)]


def test_long_text_in_pieces():
    from lexloom.llm import _text

    text = " ".join(f"w{i % 977}" for i in range(1_200_000)).encode()
    small = shingle_sets([text[:200_000]], 5)[0]
    assert len(text) > 2 * _text.SLICE
    assert np.isin(small[:-1], shingle_sets([text], 5)[0]).mean() > 0.99
