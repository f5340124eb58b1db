"""N-gram Jaccard join: universe-partition pigeonhole.

A document is the set of its distinct k-word shingles. Two sets x, y with Jaccard >= t differ in
at most H = (1-t)/(1+t) * (|x|+|y|) shingles. Sets of one size band share a partition of the
shingle universe into segments (by hash); each segment's subset of a set is named. Allocation by cost:
  0  the first H+1+e non-empty segments of a set, exactly (about a third of its size in names);
  1  where a set has fewer (short sets), one-deletion neighbourhoods of its segments of two shingles
     or more as well: a segment matched exactly is one unit, through its neighbourhood two;
  2  where these give less than H+1 units, each shingle by itself.
A set emits the names of its tier and of all lower ones, so of any two sets the one of lower tier
finds the other. Segments are taken in one order, so of two sets what ends first lies within the
other's: at most H segments differ, and linked sets of which one is not short share e+1 names or more.

A set that is not short leaves out its e names with the most holders (ties by name): of the e+1 names that
it shares with a linked one, the one with the fewest holders stays for both. So passages that very many
documents share cost nothing until they make up a good part of a set, and a set that shares e names or
fewer with others is out. This needs no list of common shingles and no threshold that follows the corpus.

Of equal sets one is named. Candidates first form stars in each name's group (every member against a
pivot; eight orders of pivots, chosen by the name), so a group of g near copies costs a few times g checks. Only
groups whose members then still lie in several components are checked across components. A pair is made
at the least name that both sets hold, as far as the LEAST least names of each tell, and only if their odd
sketches (parities of counts in hash classes) don't already differ in more places than linked sets can.

Before a text is fetched, the sets' profiles (counts of shingles in hash classes, kept for all sets
and about a tenth of a text in size) give a lower bound of the shingles two sets differ in. What is
left is verified on whole texts; components come from exact links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._tables import Scratch
from ._text import LOWER, mix, shingle_sets, slices, utf8

#: Least names that a set's rows carry.
LEAST = 12
#: Longs of a set's odd sketch.
ODD = 8
#: e of a band, as SQL; see spare().
SPARE = "if(band >= 2, greatest(1, shiftleft(2, band) div 24), 0)"
#: Rows (two longs each) up to which the ids of texts to fetch are broadcast; beyond, texts are shuffled.
BROADCAST = 500_000
_U = np.uint64


def _census(k: int, num: int, den: int):
    """Arrow batches (doc_id, th, text) -> size, two hashes, profile, names and short bands of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in slices(texts):
                sets = shingle_sets([t.translate(LOWER) for t in texts[a:b]], k)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([mix(s, 9).sum(dtype=np.uint64) for s in sets], np.uint64)
                # names once for the equal sets of a slice, at the first that has an id
                valid = np.flatnonzero(batch["doc_id"].slice(a, b - a).is_valid().to_numpy(zero_copy_only=False))
                first = valid[np.unique(h1[valid], return_index=True)[1]]
                name, place, short = signatures([sets[i] for i in first], num, den)
                order = np.argsort(place, kind="stable")
                many = np.zeros(len(sets), np.int64)
                many[first] = np.bincount(place, minlength=len(first))
                at = np.concatenate([[0], np.cumsum(many)])
                # first is not ascending: bring the names to the order of documents
                by = np.argsort(first)
                ends = np.cumsum(np.bincount(place, minlength=len(first)))
                name = name[order]
                parts = [name[ends[i] - many[first[i]] : ends[i]] for i in by]
                flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
                bands = np.zeros(len(sets), np.int64)
                bands[first] = short
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a), batch["th"].slice(a, b - a), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                        pa.array([profile(s).tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * ODD, pa.int32()), pa.array(np.concatenate([odd(s) for s in sets]))), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64))), pa.array(bands),
                    ],
                    names=["doc_id", "th", "n", "h1", "h2", "profile", "odd", "names", "short"],
                )

    return run


def profile(s: np.ndarray) -> np.ndarray:
    """Counts (255 at most) of a set's shingles in 2^j hash classes, a power that follows its size."""
    j = int(band(np.array([len(s)]))[0])
    return np.minimum(np.bincount((s >> _U(63 - j) >> _U(1)).astype(np.int64), minlength=1 << j), 255).astype(np.uint8)


def odd(s: np.ndarray) -> np.ndarray:
    """Whether a set holds an odd number of shingles in each of 64 * ODD hash classes, as longs: what differs there differs in the sets."""
    return np.packbits(np.bincount((s >> _U(40)).astype(np.int64) % (64 * ODD), minlength=64 * ODD).astype(np.uint8) & 1).view(np.int64)


def apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only, by their profiles."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    if len(a) > len(b):
        a, b = b, a
    b = np.minimum(b.reshape(len(a), -1).sum(1), 255)
    return int(np.abs(np.minimum(a, 255) - b).sum())


def band(n: np.ndarray) -> np.ndarray:
    """Size band: sizes of 2^j to 2^(j+1)-1."""
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def spare(fam: np.ndarray) -> np.ndarray:
    """e of the size bands: about three eighths of H of two sets of the band's least size at a threshold of 0.8; it depends on the band alone."""
    return np.where(fam >= 2, np.maximum(1, (np.int64(2) << fam) // 24), 0)


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all sets for threshold num/den, each name's place in sets, and the bands (as bits) in which a set is short.

    The lowest six bits of a name are its band."""
    n = np.array([len(s) for s in sets], np.int64)
    own = band(n)
    below = (np.int64(1) << own) - 1  # the largest size in the band below
    lower = np.flatnonzero((n > 0) & (own > 0) & (n * num <= below * den))
    doc = np.concatenate([np.flatnonzero(n > 0), lower])
    short = np.zeros(len(sets), np.int64)
    if not len(doc):
        return np.empty(0, np.uint64), doc, short
    fam = np.concatenate([own[n > 0], own[lower] - 1])
    partner = np.concatenate([(n * den // num)[n > 0], below[lower]])  # the largest one
    units = (n[doc] + partner) * (den - num) // (den + num) + 1
    top = (np.int64(2) << fam) - 1
    segments = ((top + top * den // num) * (den - num) // (den + num) + 1 + spare(fam)) * 27 // 25 + 2
    label = fam.astype(np.uint64)
    ended = lambda x, of: mix(x, 80) & ~_U(63) | label[of]
    s, size = np.concatenate([sets[i] for i in doc]), n[doc]
    of = np.repeat(np.arange(len(doc)), size)
    base = np.concatenate([[0], np.cumsum(segments)])
    seg = base[of] + ((mix(s, 50) ^ mix(label, 3)[of] >> _U(32)) % segments.astype(np.uint64)[of]).astype(np.int64)
    value = mix(s, 60)
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, seg, value)
    held = np.bincount(seg, minlength=base[-1])
    owner = np.repeat(np.arange(len(doc)), segments)
    sums += mix((np.arange(base[-1]) - base[owner]).astype(np.uint64) * _U(64) + label[owner], 70)
    full = held > 0
    rank = np.cumsum(full)
    rank = rank - np.concatenate([[0], rank])[base[owner]]
    chosen = full & (rank <= (units + spare(fam))[owner])
    names, place = [ended(sums[chosen], owner[chosen])], [doc[owner[chosen]]]
    exact = np.bincount(owner[full], minlength=len(doc))
    less = exact < units + spare(fam)
    np.bitwise_or.at(short, doc[less], np.int64(1) << fam[less])
    # one-deletion neighbourhoods
    gone = less[of] & (held[seg] > 1)
    names.append(ended(sums[seg[gone]] - value[gone], of[gone]))
    place.append(doc[of[gone]])
    alone = (less & (exact + np.bincount(owner[held > 1], minlength=len(doc)) < units))[of]
    names.append(ended(mix(s[alone], 90), of[alone]))
    place.append(doc[of[alone]])
    return np.concatenate(names), np.concatenate(place), short


def _near(num: int, den: int):
    """Arrow batches (a, b, na, nb, pa, pb) -> the pairs (a, b) that their profiles don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["na"].to_pylist(), batch["nb"].to_pylist(), batch["pa"].to_pylist(), batch["pb"].to_pylist(), strict=True)
            keep = pa.array([apart(x, y) * (num + den) <= (n + m) * (den - num) for n, m, x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


def _verify(k: int, num: int, den: int):
    """Arrow batches (a, b, text_a, text_b) -> the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, keep = utf8(batch["text_a"]), utf8(batch["text_b"]), np.zeros(batch.num_rows, bool)
            for a, b in slices([p + q for p, q in zip(x, y, strict=True)]):
                one = shingle_sets([t.translate(LOWER) for t in x[a:b]], k)
                two = shingle_sets([t.translate(LOWER) for t in y[a:b]], k)
                for i, (s, t) in enumerate(zip(one, two, strict=True)):
                    both = np.sort(np.concatenate([s, t]))
                    inter = int((both[1:] == both[:-1]).sum())
                    keep[a + i] = inter > 0 and den * inter >= num * (len(s) + len(t) - inter)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])

    return run


_OUT = ["doc_id", "n_shingles", "component_id", "group_id", "text_hash"]


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, keep: list[str] = _OUT) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, n_shingles, component_id, group_id, text_hash (those in keep) for each row; no other columns are used.

    Words are split at space and tab..CR after A-Z are lower-cased. Texts of 1 to k-1 words have one
    shingle. Null or wordless texts have none, link with nothing and are their own component (group_id null). Rows
    with a null doc_id get their count and nulls. Repeated rows count as equal sets; different texts
    under one doc_id are sets of their own, and each of their rows gets its own set's component. doc_id is cast to a whole
    number (what is none becomes null). group_id tells components apart where repeated ids give them one least id. An
    empty table gives an empty result. Sets link when den*|x&y| >= num*|x|y|, ties included."""
    scratch = Scratch(docs.sparkSession, "ngram")
    rows = docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    census = scratch.save(rows.mapInArrow(_census(k, num, den), "doc_id long, th long, n long, h1 long, h2 long, profile binary, odd array<long>, names array<long>, short long").withColumn("node", F.monotonically_increasing_id()))
    known = census.filter("n > 0 and doc_id is not null")
    # of equal sets one row with names stands for all; its number is the set's node
    least = known.groupBy("h1", "h2").agg(F.min(F.when(F.size("names") > 0, F.col("node"))).alias("node"), F.min("doc_id").alias("lowest"))
    sets = scratch.save(known.join(least.drop("h1", "h2"), "node").drop("doc_id", "th"))
    whole, census = census, scratch.save(census.select("doc_id", "th", "n", "h1", "h2", "node"))
    scratch.drop(whole)  # the names of copies with it

    names = F.array_distinct("names")
    shared = sets.select(F.explode(names).alias("sig")).groupBy("sig").agg(F.count("*").alias("holders")).filter("holders > 1")
    held = sets.select("node", F.explode(names).alias("sig")).join(shared, "sig").withColumn("band", F.col("sig").bitwiseAND(63).cast("int"))
    listed = held.groupBy("node", "band").agg(F.sort_array(F.collect_list(F.struct("holders", "sig"))).alias("all"))
    left = F.expr(f"greatest(0, size(all) - if((shiftright(short, band) & 1) = 1, 0, {SPARE}))").cast("int")
    listed = listed.join(sets.select("node", "n", "short"), "node")
    member = scratch.save(listed.select("node", "n", F.explode(F.slice("all", F.lit(1), left)).alias("x")).select("x.sig", "node", "n"))
    fits = f"greatest({{0}}.n, {{1}}.n) * {num} <= least({{0}}.n, {{1}}.n) * {den}"
    shapes = sets.select("node", "n", "profile")

    def check(pairs: DataFrame) -> DataFrame:
        x = shapes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"))
        y = shapes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
        near = scratch.save(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_near(num, den), "a long, b long"))
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(census.select("node", "doc_id", "th"), "node")
        wanted = scratch.save(wanted)
        texts = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, ["doc_id", "th"])
        texts = scratch.save(texts.select("node", "text").dropDuplicates(["node"]))
        x = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        y = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return scratch.save(near.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, num, den), "a long, b long"))

    turn = F.xxhash64("node", F.shiftright("sig", 7).bitwiseAND(7))
    pivots = member.groupBy("sig").agg(F.min(F.struct(turn.alias("turn"), "node", "n")).alias("p"))
    star = member.select("sig", F.struct("node", "n").alias("x")).join(pivots, "sig").filter("x.node <> p.node").filter(fits.format("x", "p"))
    tried = scratch.save(star.selectExpr("least(x.node, p.node) a", "greatest(x.node, p.node) b").distinct())
    links = check(tried)
    label = scratch.save(components(links, scratch))
    member = member.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = member.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("sig")
    rest = scratch.save(member.join(split, "sig"))
    first = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LEAST).alias("least"))
    rest = scratch.save(rest.join(first, "node").join(sets.select("node", "odd"), "node").withColumn("least", F.expr("filter(least, s -> s < sig)")))
    x, y = (rest.select("sig", F.struct("node", "n", "component", "odd", "least").alias(c)) for c in "xy")
    differ = " + ".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(ODD))
    pairs = x.join(y, "sig").filter("x.node < y.node and x.component <> y.component").filter(fits.format("x", "y"))
    pairs = pairs.filter(f"({differ}) * {num + den} <= (x.n + y.n) * {den - num}").filter("not arrays_overlap(x.least, y.least)")
    links = links.unionByName(check(scratch.save(pairs.selectExpr("x.node a", "y.node b").distinct().join(tried, ["a", "b"], "left_anti"))))
    label = components(links, scratch)
    classes = sets.join(label, "node", "left").select("h1", "h2", "lowest", F.coalesce("component", "node").alias("group_id"))
    lowest = classes.groupBy("group_id").agg(F.min("lowest").alias("component_id"))
    classes = scratch.save(classes.drop("lowest").join(lowest, "group_id"))
    out = census.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", F.col("th").alias("text_hash")).join(classes, ["h1", "h2"], "left")
    is_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    scratch.keep_only(census, classes)
    out = out.withColumn("component_id", F.when(is_set, F.col("component_id")).otherwise(F.col("doc_id"))).withColumn("group_id", F.when(is_set, F.col("group_id")))
    return out.select(*keep)
