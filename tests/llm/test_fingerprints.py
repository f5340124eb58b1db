import hashlib
import random

from pyspark.sql import functions as F

from lexloom.llm import fingerprints


def test_query_matches_rules(spark, sf):
    from lexloom.llm.queries import op4_fingerprints

    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in op4_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)]
        k = len(t) // 3
        edited = t[: len(t) - k] + following[1][:k]
        r, n = rows[d], rows[following[0]]
        (a, x), (b, y), (c, z) = zip(*fingerprints.sketches([t.encode(), edited.encode(), following[1].encode()]), strict=True)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.written(a, x) and r.edited_fingerprint == fingerprints.written(b, y) and n.fingerprint == fingerprints.written(c, z)
        assert r.near_edited == fingerprints.alike((a, x), (b, y)) and r.near_next == fingerprints.alike((a, x), (c, z))
        assert 0 <= r.near_next <= 1 and (t != following[1] or r.near_next == 1)
    long = [r for r in rows.values() if r.n_chars > 2000]
    assert sum(r.near_edited for r in long) / len(long) > 0.35
    distinct = [r for r in long if r.near_next < 1]
    assert sum(r.near_next for r in distinct) / len(distinct) < 0.2


def test_inner_phrases_do_not_depend_on_offset():
    r = random.Random(1)
    middle = "".join(r.choice("abcdefgh ") for _ in range(4000))
    ends = ["".join(r.choice("xyz") for _ in range(n)) for n in (0, 1, 7, 100)]
    (root, first), *others = zip(*fingerprints.sketches([(e + middle + e[::-1]).encode() for e in ends]), strict=True)
    assert all(fingerprints.alike((root, first), o) > 0.8 for o in others)
    alone = zip(*fingerprints.sketches([(ends[3] + middle).encode()]), strict=True)
    together = list(zip(*fingerprints.sketches([b"abc", (ends[3] + middle).encode(), b"", b"aaaa", b"z"]), strict=True))
    assert fingerprints.written(*next(iter(alone))) == fingerprints.written(*together[1])


def test_frames(spark):
    rows = [(3, "x" * 50_000, "a"), (2, None, "b"), (1, "", None), (1, "", None), (None, "some text", "c"), (9, "same text here", "d"), (8, "same text here", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = fingerprints.fingerprint(docs).withColumn("own", fingerprints.likeness(F.col("fingerprint"), F.col("fingerprint"))).collect()
    assert len(got) == len(rows) and all(r.own == 1.0 for r in got)
    assert len({r.fingerprint for r in got if not r.text}) == 1
    report = {(r.doc_id, r.n_chars): r for r in fingerprints.edit_report(docs).collect()}
    assert report[9, 14].near_next == 1.0 and report[9, 14].edited_sha256 == hashlib.sha256(b"same text same").hexdigest()
    assert report[None, 9].edited_sha256 == hashlib.sha256(b"some tsam").hexdigest()
    assert fingerprints.edit_report(docs).count() == len(rows)
    one = fingerprints.edit_report(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.edit_report(docs.limit(0)).collect() == []


def test_likeness_column(spark):
    texts = ["a few words and then some more of them. " * 20, "a few words and then some more of them. " * 15 + "other things come now, not the same ones at all. " * 5]
    (a, b) = zip(*fingerprints.sketches([t.encode() for t in texts]), strict=True)
    row = spark.createDataFrame([(fingerprints.written(*a), fingerprints.written(*b))], "a string, b string").select(fingerprints.likeness(F.col("a"), F.col("b"))).first()[0]
    assert abs(row - fingerprints.alike(a, b)) < 1e-12


M64 = (1 << 64) - 1


def plain_mix(x, salt):
    x ^= (salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_labels(names):
    """Tossed against the left neighbour until all are below 6; the first one's neighbour is itself with another lowest bit."""
    for _ in range(3 if max(names, default=0) < 256 and plain_labels.level == 0 else 4):
        lefts = [names[0] ^ 1, *names[:-1]]
        tossed = []
        for left, own in zip(lefts, names, strict=True):
            place = 0
            while left != own and (left >> place & 1) == (own >> place & 1):
                place += 1
            tossed.append(2 * place + (own >> place & 1))
        names = tossed
    return names


def plain_parse(text):
    """The fingerprint by plain loops over one text, level by level."""
    names, level, kept, root = list(text), 0, [], 0
    while names:
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        plain_labels.level = level
        label = plain_labels([x for x, _ in runs])
        assert all(0 <= x < 6 for x in label)
        phrases = []
        for i, run in enumerate(runs):
            peak = 0 < i < len(runs) - 1 and label[i] > label[i - 1] and label[i] > label[i + 1]
            if i == 0 or peak:
                phrases.append([])
            phrases[-1].append(run)
        level += 1
        names = [plain_mix(sum(plain_mix((x + n * 0x9E3779B97F4A7C15 + place * 0xC2B2AE3D27D4EB4F) & M64, 31) for place, (x, n) in enumerate(p)) & M64, 32) for p in phrases]
        if level >= 3 or len(names) == 1:
            kept += names
        if len(names) == 1:
            root = names[0]
            break
    least = ["ffffff"] * 64
    for x in kept:
        held = plain_mix(x, 33)
        least[held >> 58] = min(least[held >> 58], f"{held & 0xFFFFFE:06x}")
    return f"{root:016x}" + "".join(least)


def test_fingerprints_equal_a_plain_parse(spark, sf):
    rng = random.Random(11)
    texts = ["", "a", "ab", "aab", "z" * 300, "ab" * 200, "é日本😀" * 30, "".join(rng.choice("ab \n") for _ in range(5000)), "".join(chr(rng.randint(1, 0x7FF)) for _ in range(3000))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    got = fingerprints.fingerprint(spark.createDataFrame(enumerate(texts), "i int, text string")).collect()
    assert {r.i: r.fingerprint for r in got} == {i: plain_parse(t.encode()) for i, t in enumerate(texts)}


def test_empty_table(spark):
    out = fingerprints.fingerprint(spark.createDataFrame([], "text string, source string"))
    assert out.collect() == [] and out.columns == ["text", "source", "fingerprint"]
