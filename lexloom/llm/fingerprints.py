"""Document fingerprints: locally consistent parsing by deterministic coin tossing.

A text's bytes are parsed into phrases, level by level. At each level runs of equal names are one
symbol; coin tossing against the left neighbour (twice the place of the lowest differing bit, plus
that bit) makes the names of neighbours into labels below 6 that still differ; phrases begin at
local maxima of labels and get names by hashing what they hold. Whether a phrase begins somewhere
depends on a few symbols around it alone, so equal substrings have equal phrases inside, whatever
their offset. Parsing ends when one name is left, the root.

A fingerprint is the root's name and, over the names of levels FROM and up, the least value in each
of BINS classes of names. Likeness is the share of classes that agree of those that either has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import extended
from ._text import mix, slices, utf8

BINS, FROM, DIGITS = 64, 3, 6
_NONE = (1 << 4 * DIGITS) - 1
_U = np.uint64


def _toss(bits: int) -> np.ndarray:
    """Labels of neighbours (left, own) of so many bits; equal ones, which don't occur, get 0."""
    left, own = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    low = (left ^ own) & -(left ^ own)
    k = np.where(low > 0, np.log2(np.maximum(low, 1)), 0).astype(np.int64)
    return (2 * k + (own >> k & 1)).astype(np.uint8).ravel()


_T8, _T7, _T4, _T3 = _toss(8), _toss(7), _toss(4), _toss(3)


def _next(label: np.ndarray, first: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = label[first] ^ 1
    return table[left.astype(np.int32) << bits | label]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    if names.dtype == np.uint8:
        label, rounds = _next(names, first, _T8, 8), ((_T4, 4), (_T3, 3))
    else:
        left = np.empty_like(names)
        left[1:] = names[:-1]
        left[first] = names[first] ^ _U(1)
        low = left ^ names
        low &= ~low + _U(1)
        k = (low.astype(np.float64).view(np.int64) >> 52) - 1023
        label, rounds = (2 * k + ((names & low) != 0)).astype(np.uint8), ((_T7, 7), (_T4, 4), (_T3, 3))
    for table, bits in rounds:
        label = _next(label, first, table, bits)
    return label


def _level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names and where each text's begin; first: where each text's names begin (none is empty)."""
    start = np.empty(len(names), bool)
    start[0] = True
    np.not_equal(names[1:], names[:-1], out=start[1:])
    start[first] = True
    run = np.flatnonzero(start)
    size = np.diff(np.append(run, len(names)))
    symbol = names[run]
    first = np.searchsorted(run, first)
    label = _labels(symbol, first)
    begin = np.zeros(len(symbol), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[first[1:] - 1] = False  # no phrase for a text's last symbol alone
    begin[first] = True
    at = np.flatnonzero(begin)
    place = np.arange(len(symbol)) - np.repeat(at, np.diff(np.append(at, len(symbol))))
    part = mix(symbol.astype(_U) + size.astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U) * _U(0xC2B2AE3D27D4EB4F), 31)
    return mix(np.add.reduceat(part, at), 32), np.searchsorted(at, first)


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Roots (0 for an empty text) and BINS least values of each text."""
    roots, least = np.zeros(len(texts), _U), np.full(len(texts) * BINS, _NONE, np.int64)
    alive = np.array([i for i, t in enumerate(texts) if t], np.int64)
    names = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in alive])])[:-1].astype(np.int64)
    level = 0
    while len(alive):
        names, first = _level(names, first)
        level += 1
        size = np.diff(np.append(first, len(names)))
        done = size == 1
        owner = np.repeat(alive, size)
        taken = np.ones(len(names), bool) if level >= FROM else np.repeat(done, size)
        held = mix(names[taken], 33)
        np.minimum.at(least, owner[taken] * BINS + (held >> _U(58)).astype(np.int64), (held & _U(_NONE - 1)).astype(np.int64))
        roots[alive[done]] = names[first[done]]
        names = names[np.repeat(~done, size)]
        alive, size = alive[~done], size[~done]
        first = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    return roots, least.reshape(len(texts), BINS)


def written(root: np.uint64, least: np.ndarray) -> str:
    return f"{int(root):016x}" + "".join([f"{x:0{DIGITS}x}" for x in least.tolist()])


def alike(a: tuple[np.uint64, np.ndarray], b: tuple[np.uint64, np.ndarray]) -> float:
    if a[0] == b[0]:
        return 1.0
    either = (a[1] != _NONE) | (b[1] != _NONE)
    return float(((a[1] == b[1]) & either).sum() / max(1, either.sum()))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from 0 to 1; null if either is null."""
    part = lambda x, i: F.substring(x, F.lit(17) + i * DIGITS, F.lit(DIGITS))
    void = "f" * DIGITS
    both = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct(part(a, i).alias("x"), part(b, i).alias("y")))
    some = F.filter(both, lambda p: (p["x"] != void) | (p["y"] != void))
    return F.when(F.substring(a, 1, 16) == F.substring(b, 1, 16), F.lit(1.0)).when(a.isNotNull() & b.isNotNull(), F.size(F.filter(some, lambda p: p["x"] == p["y"])) / F.greatest(F.size(some), F.lit(1)))


def fingerprint(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (text, more) -> the columns of keep (all by default) and fingerprint; null texts are empty.

    Equal texts have equal fingerprints. A column of that name is replaced. One row for each row; an empty table gives an empty result."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    schema = extended(docs, kept, "fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in slices(texts):
                out = [written(r, s) for r, s in zip(*sketches(texts[a:b]), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in kept), pa.array(out, pa.string())], names=[*kept, "fingerprint"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def _cut(text: bytes, chars: int) -> int:
    """The byte after the first chars code points."""
    b = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((b & 0xC0) != 0x80)
    return int(at[chars]) if chars < len(at) else len(text)


def edited(text: bytes, following: bytes) -> bytes:
    """text with its last third (in code points, rounded down) replaced by as many code points of following, or all."""
    n = int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
    return text[: _cut(text, n - n // 3)] + following[: _cut(following, n // 3)]


def with_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> rows (range, ahead, doc_id, text) in which every document is followed by the next by descending doc_id.

    Documents go to ranges of doc_id; each range ends with a copy of the first document of the next one (ahead), the
    last with that of the very first. Equal doc_ids follow each other by their texts' hash; null ones come last."""
    spark = docs.sparkSession
    ranges = ranges or max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # follows what the cluster is set to
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("e")).first()[0]  # one number for each range
    edges = sorted(set(known or ()), reverse=True)
    step = max(1, int(len(edges) ** 0.5))
    coarse, fine = edges[::step], [edges[i : i + step] for i in range(0, len(edges), step)]

    def below(edge: list[int]) -> Column:
        return F.size(F.filter(F.lit(edge).cast("array<long>"), lambda e: e > F.col("doc_id"))) if edge else F.lit(0)

    if edges:
        top = below(coarse)
        place = F.when(top == 0, F.lit(0)).otherwise((top - 1) * step + F.size(F.filter(F.element_at(F.lit(fine).cast("array<array<long>>"), F.greatest(top, F.lit(1))), lambda e: e > F.col("doc_id"))))
    else:
        place = F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(place)).withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))
    heads = sorted(rows.groupBy("range").agg(F.min(F.struct(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("k"), "th")).alias("h")).collect())  # one row for each range
    # the head of each range goes besides to the end of the range before it
    firsts = [(r, x["th"], None if x["k"] == 2**63 - 1 else -x["k"], heads[i - 1][0]) for i, (r, x) in enumerate(heads)]
    heads = F.broadcast(spark.createDataFrame(firsts, "range int, th long, doc_id long, before int"))  # one row for each range
    same = (rows["range"] == heads["range"]) & (rows["th"] == heads["th"]) & rows["doc_id"].eqNullSafe(heads["doc_id"])
    rows = rows.join(heads, same, "left").select(rows["range"], rows["doc_id"], "text", rows["th"], "before")
    own = F.struct("range", F.lit(False).alias("ahead"))
    at = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))))
    rows = rows.withColumn("at", F.explode(at)).select("at.range", "at.ahead", "doc_id", "text", "th")
    return rows.repartition("range").sortWithinPartitions("range", "ahead", F.col("doc_id").desc_nulls_last(), "th").drop("th")


def edit_report(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    Null texts are empty; a single document's next is itself; an empty table gives an empty result."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def report(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (range, ahead, doc_id, text); all but the last get a line, if they aren't ahead."""
        texts = [r[3] for r in rows]
        fresh = [edited(t, u) for t, u in zip(texts[:-1], texts[1:], strict=True)]
        both = list(zip(*sketches(texts + fresh), strict=True))
        own, other, out = both[: len(texts)], both[len(texts) :], []
        for i, r in enumerate(rows[:-1]):
            if not r[1]:
                n = int(((np.frombuffer(r[3], np.uint8) & 0xC0) != 0x80).sum())
                out.append((r[2], n, hashlib.sha256(fresh[i]).hexdigest(), written(*own[i]), written(*other[i]), alike(own[i], other[i]), alike(own[i], own[i + 1])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            rows = list(zip(batch["range"].to_pylist(), batch["ahead"].to_pylist(), batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True))
            for a, b in slices([r[3] for r in rows]):
                part = last + rows[a:b]
                yield report(part)
                last = part[-1:]

    return with_neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
