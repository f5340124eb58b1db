"""Token ids over two segmentations: each rule by hand, sentences that lose their step, long ones."""

import random

import pytest

from lexloom.operators import realign

X = "X"


def side(text):
    """`form/tag form ...`"""
    return [(w.split("/") + [X])[:2] for w in text.split()]


def go(old, new):
    return [m and (m[0], m[1]) for m in realign.matched([tuple(x) for x in side(old)], [tuple(x) for x in side(new)])]


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ("ab cd", "ab cd", [(0, "equal"), (1, "equal")]),
        ("B HBIT X", "BBIT X", [(0, "fused_h"), (2, "equal")]),
        ("ab cd e", "abcd e", [(0, "fused"), (2, "equal")]),
        ("abcd e", "ab cd e", [(0, "part"), (0, "rest"), (1, "equal")]),
        ("abcx q/S_PRN e", "abcy e", [(0, "old_suffix"), (2, "equal")]),
        ("abcx e", "abcy q/S_PRN e", [(0, "new_suffix"), (0, "new_suffix"), (1, "equal")]),
        ("abc de f", "ab cde f", [(0, "pairs"), (1, "pairs"), (2, "equal")]),
        ("EM HA/S_PRN e", "AT HA/S_PRN e", [(0, "particles"), (1, "equal"), (2, "equal")]),
        ("AT e", "ATH/S_PRN e", [(0, "with_her"), (1, "equal")]),
        ("LW e", "L/IN HWA/S_PRN e", [(0, "in_suffix"), (0, "in_suffix"), (1, "equal")]),
        ("BW/IN HWA/S_PRN e", "B/PREPOSITION q e", [(0, "b_suffix"), (0, "b_suffix"), (2, "equal")]),
        ("abc d", "a b c d", [(0, "three"), (0, "three"), (0, "three"), (1, "equal")]),
        ("mn d", "p q/IN r/S_PRN d", [(0, "three_suffix"), (0, "three_suffix"), (0, "three_suffix"), (1, "equal")]),
        ("ac d", "a b c d", [(0, "around"), (0, "around"), (0, "around"), (1, "equal")]),
        ("k lm n", "k H lm n", [(0, "equal"), (1, "inner_h"), (1, "equal"), (2, "equal")]),
    ],
)
def test_each_rule(old, new, want):
    assert go(old, new) == want


def test_step_is_found_again():
    assert go("a b c d e", "a q c d e") == [(0, "equal"), None, (2, "equal"), (3, "equal"), (4, "equal")]
    assert go("a b b c", "a q b c") == [(0, "equal"), None, (1, "equal"), (3, "equal")]
    assert go("a b c d e f", "a x y e f") == [(0, "equal"), None, None, (4, "equal"), (5, "equal")]
    assert go("a b", "a b c") == [(0, "equal"), (1, "equal"), None] and go("", "a") == [None] and go("a", "") == []
    # the cut token after the lost one is still matched by its rule
    assert go("a b wxyz e", "a q wx yz e") == [(0, "equal"), None, (2, "part"), (2, "rest"), (4 - 1, "equal")]


def test_random_sentences_keep_order_and_forms():
    rng = random.Random(3)
    for _ in range(300):
        old = [("".join(rng.choices("abc", k=rng.randint(1, 4))), X) for _ in range(rng.randint(0, 12))]
        new = [x for x in old if rng.random() < 0.8]
        for _ in range(rng.randint(0, 3)):
            new.insert(rng.randint(0, len(new)), ("".join(rng.choices("abcd", k=rng.randint(1, 4))), X))
        got = realign.matched(old, new)
        places = [m[0] for m in got if m]
        assert len(got) == len(new) and places == sorted(places)
        assert all(old[m[0]][0] == new[i][0] for i, m in enumerate(got) if m and m[1] == "equal")


def test_long_sentence_is_linear():
    rng = random.Random(5)
    old = [(f"w{i}" if i % 3 else rng.choice("abcdefgh"), X) for i in range(60_000)]
    new = [x for i, x in enumerate(old) if i % 50]
    got = realign.matched(old, new)
    assert all(m and old[m[0]] == x for m, x in zip(got, new, strict=True) if x[0][0] == "w")


def test_rows_of_a_table(spark):
    old = spark.createDataFrame([(s, 10 + i, f, 100 + i, t) for s, text in ((1, "B HBIT X"), (2, "a b"), (4, "z")) for i, (f, t) in enumerate(side(text))], "s int, pos int, form string, tok_id int, cpos string")
    new = spark.createDataFrame([(s, i, f, t) for s, text in ((1, "BBIT X"), (2, "a b"), (3, "q")) for i, (f, t) in enumerate(side(text))] + [(2, 9, None, None)], "s int, pos int, form string, cpos string")
    out = realign.realign_tokens(old, new, ["s"])
    assert sorted((r.s, r.pos, r.tok_id, r.rule) for r in out.collect()) == [(1, 0, 100, "fused_h"), (1, 1, 102, "equal"), (2, 0, 100, "equal"), (2, 1, 101, "equal"), (2, 9, None, "none"), (3, 0, None, "none")]
    assert {r.kind: r.n for r in realign.realign_report(old, out, ["s"]).collect()} == {"match": 1, "nomatch": 2}
    assert realign.realign_tokens(old, new.filter("false"), ["s"]).collect() == []


def _random_sides(rng):
    word = lambda: ("".join(rng.choices("abH", k=rng.randint(1, 3))) if rng.random() < 0.8 else rng.choice(["EM", "AT", "ATH", "B", "H", "EMx", "ATy"]), rng.choice([X, X, X, "S_PRN", "IN", "PREPOSITION"]))
    old, new = [word() for _ in range(rng.randint(0, 14))], []
    for w in old:
        new += [w] if rng.random() < 0.6 else [word()] if rng.random() < 0.5 else [(w[0][:1], X), (w[0][1:] or "a", w[1])]
    return old, new


def test_rows_of_costs_give_what_cells_give(monkeypatch):
    rng = random.Random(11)
    for n in range(800):
        old, new = _random_sides(rng)
        s = realign.Sides(old, new)
        i, j = rng.randint(0, len(new)), rng.randint(0, len(old))
        end, old_end = rng.randint(i, len(new)), rng.randint(j, len(old))
        monkeypatch.setattr(realign, "HELD", 0 if n % 2 else 8_000_000)
        one, two = [None] * len(new), [None] * len(new)
        realign._fewest_left_out(s, i, end, j, old_end, one)
        realign._fewest_left_out_by_rows(s, i, end, j, old_end, two)
        assert one == two, (old, new, i, end, j, old_end)


def test_rows_know_every_rule():
    rng = random.Random(12)
    for _ in range(400):
        old, new = _random_sides(rng)
        s = realign.Sides(old, new)
        rows = realign._Rows(s, len(new), 0, len(old))
        for a in range(len(new)):
            got = {(t, o, b) for t, o, here in rows.fits(a) for b in range(len(old)) if here[b] and a + t <= len(new) and b + o <= len(old)}
            assert got == {(t, o, b) for b in range(len(old)) for _, t, o in realign._fits(s, a, b, len(new), len(old))}


def test_long_stretch_without_anchors_is_matched_as_a_short_one():
    """Rules from the left alone would lose their step for good at the first strange morpheme."""
    rng = random.Random(13)
    old = [(rng.choice("abcd"), X) for _ in range(3000)]
    new = old[:10] + [("@@", X)] + old[10:]
    got = realign.matched(old, new)
    assert got[10] is None and all(m is not None for k, m in enumerate(got) if k != 10)


def test_equal_cells_and_rows_of_a_long_stretch(monkeypatch):
    rng = random.Random(14)
    old = [(rng.choice("abcd"), X) for _ in range(120)]
    new = [x for x in old if rng.random() < 0.9]
    new.insert(5, ("@@", X))
    found = []
    for cells in (10**9, 0):
        monkeypatch.setattr(realign, "CELLS", cells)
        found.append(realign.matched(old, new))
    assert found[0] == found[1]


def test_rows_of_sentences_are_matched_as_tables_are(spark):
    old = spark.createDataFrame([(s, 10 + i, f, 100 + i, t) for s, text in ((1, "B HBIT X"), (2, "a b"), (4, "z")) for i, (f, t) in enumerate(side(text))], "s int, pos int, form string, tok_id int, cpos string")
    new = spark.createDataFrame([(s, i, f, t) for s, text in ((1, "BBIT X"), (2, "a b"), (3, "q"), (4, "z")) for i, (f, t) in enumerate(side(text))], "s int, pos int, form string, cpos string")
    rows = lambda df: df.groupBy("s").agg(realign.F.expr("array_sort(collect_list(struct(pos, form, cpos as tag)))").alias("a"))
    both = rows(new).withColumnRenamed("a", "n").join(rows(old).withColumnRenamed("a", "o"), "s", "left")
    want = realign.realign_report(old, realign.realign_tokens(old, new, ["s"]), ["s"])
    assert sorted(map(tuple, realign.realign_report_rows(realign.matched_rows(both, ["s"])).collect())) == sorted(map(tuple, want.collect()))


def test_only_lines_are_shuffled(spark, sf):
    from lexloom.plans import catalog
    from tests.test_slices import shuffles

    for name, more in (("j22_realign", 0), ("j22_realign_report", 1)):  # the report is counted by kind
        by = shuffles(catalog.QUERIES[name](spark, sf))
        assert by.count("doc_id, line_no") == 1 and len(by) == 1 + more, name
