"""Deviation from the requested weights themselves, over far more than one period."""

import pytest

from lexloom.llm import mixing


@pytest.mark.parametrize("shares", [
    {f"s{i:03d}": 0.5 if i == 0 else 0.5 / 19 for i in range(20)}, {f"s{i:03d}": 0.9 if i == 0 else 0.1 / 299 for i in range(300)},
    {"a": 0.7123456789, "b": 0.2, "c": 0.0876543211}, {"a": 1e9, "b": 1.0},
])
def test_no_source_is_a_block_off(shares):
    n, total = 30_000, sum(shares.values())
    plan = list(mixing.deal(shares, {s: int(n * x / total) + 5 for s, x in shares.items()}))
    done = dict.fromkeys(shares, 0)
    for s, j, t, release, due in plan:
        if t >= n:
            break
        assert release <= t < due and j == done[s]
        assert abs(done[s] - shares[s] / total * t) < 1.001
        done[s] += 1
        if t % 997 == 0 or t == n - 1:
            assert all(abs(done[x] - shares[x] / total * (t + 1)) < 1.001 for x in shares), t
    assert sum(done.values()) == n


def test_sources_without_weight_come_last(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(900)], "doc_id long, source string")
    got = mixing.mix(docs, mixing.target_slots(docs, {"a": 0.9, "b": 0.1}), 4).collect()
    assert len(got) == 900 and min(r.slot for r in got if r.source == "c") > max(r.slot for r in got if r.source != "c")
    slots = sorted({(r.slot, r.source) for r in got})
    assert len({t for t, _ in slots}) == len(slots) == 225
    assert abs(sum(s == "a" for _, s in slots[:50]) - 45) < 1


def naive(weights, blocks):
    """Slot by slot over all sources: of the released blocks the one that is due first."""
    from fractions import Fraction
    from math import ceil, floor

    total = sum(Fraction(w) for w in weights.values())
    share, done, t, out = {s: Fraction(weights[s]) / total for s in blocks}, dict.fromkeys(blocks, 0), 0, []
    while any(done[s] < blocks[s] for s in blocks):
        ready = [(ceil((done[s] + 1) / share[s]), ceil((done[s] + 2) / share[s]), s) for s in blocks if done[s] < blocks[s] and floor(done[s] / share[s]) <= t]
        if ready:
            s = min(ready)[2]
            out.append((s, done[s], t))
            done[s] += 1
        t += 1
    return out


def test_documents_get_the_naive_schedule(spark):
    sizes = {"a": 137, "b": 64, "c": 9, "": 31}
    docs = spark.createDataFrame([(1000 * i + j, s or None) for i, (s, n) in enumerate(sizes.items()) for j in range(n)], "doc_id long, source string").repartition(3)
    weights, block = {"a": 0.47, "b": 0.31, "c": 0.02, "": 0.2}, 4
    slot_of = {(s, j): t for s, j, t in naive(weights, {s: -(-n // block) for s, n in sizes.items()})}
    got = mixing.mix(docs, mixing.target_slots(docs, weights), block).collect()
    assert {(r.source or "", r.block): r.slot for r in got} == slot_of
    for s, n in sizes.items():
        own = [r for r in got if (r.source or "") == s]
        assert sorted(r.block * block + r.place for r in own) == list(range(n))


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 10)
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1000)], "doc_id long, source string")
    got = mixing.mix(docs, mixing.target_slots(docs)).collect()
    assert len(got) == 1000 and max(r.place for r in got) == 99 and len({r.slot for r in got}) == 10
    monkeypatch.setattr(mixing, "SOURCES", 1)
    with pytest.raises(ValueError, match="more than 1 sources"):
        mixing.target_slots(docs)


def test_rows_without_a_key_are_spread(spark):
    docs = spark.createDataFrame([(None, "a", f"t{i}") for i in range(9000)], "doc_id long, source string, text string")
    rows = mixing.numbered(docs)
    assert sorted(r["rank"] for r in rows.select("rank").collect()) == list(range(9000))
    again = {r.text: r["rank"] for r in mixing.numbered(docs.repartition(7)).collect()}
    assert again == {r.text: r["rank"] for r in rows.collect()}
