"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Texts become hashed counts of their words (half of the features) and of words' shapes, endings and
lengths (the other half), weighted by the inverse document frequencies of the whole corpus. A bounded sample of labelled documents (LABELLED of them) gives the
latent space (a truncated SVD) and stays as labelled vectors, which are broadcast: LABELLED * RANK
floats, whatever the corpus. Every document's vector is multiplied with all of them in blocks, and
its NEAREST neighbours by exact cosine vote with their labels, weighted by similarity and by how rare
their label is in the sample.

Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import extended
from ._text import hash_words, mix, slices, utf8

#: Features; labelled documents at most in the sample; latent dimensions; neighbours; documents in a block.
FEATURES, LABELLED, RANK, NEAREST, BLOCKED = 2048, 4000, 64, 25, 256
EXTRA, TERMS = 16, 1024
_CLASS = np.zeros(256, np.uint8)  # 0 letter bytes a-z and beyond ASCII, 1 A-Z, 2 digit, 3.. signs
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _i, _b in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_b] = 3 + _i % 13


def features(texts: list[bytes]) -> np.ndarray:
    """Hashed counts (documents x FEATURES): for each word itself, its shape (runs of byte classes), its last two bytes and its length; and repeated words."""
    data = b" ".join(texts)
    b = np.frombuffer(data, np.uint8)
    name, starts, ends = hash_words(data)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = np.searchsorted(first, starts, side="right") - 1
    kind = _CLASS[b]
    if not len(starts):
        return np.zeros((len(texts), FEATURES), np.float32)
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    change[starts] = True
    # a word's shape is the sequence of byte classes in it, each run of one class counted once
    runs = np.cumsum(change)
    code = np.where(change, _SHAPE[kind] * mix((runs - runs[_owner(starts, len(b))]).astype(np.uint64)), np.uint64(0))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(code, out=total[1:])
    shape = total[ends] - total[starts]
    length = np.minimum(ends - starts, 24).astype(np.uint64)
    tail = b[ends - 1].astype(np.uint64) * np.uint64(256) + b[np.maximum(ends - 2, starts)]
    n = len(texts)
    out = np.zeros(n * FEATURES, np.float32)
    for salt, value in ((1, shape), (2, tail), (3, length), (4, shape * np.uint64(31) + length)):
        out += np.bincount(doc * FEATURES + TERMS + (mix(value, salt) % np.uint64(FEATURES - TERMS - EXTRA)).astype(np.int64), minlength=n * FEATURES)
    out += np.bincount(doc * FEATURES + (mix(name, 5) % np.uint64(TERMS)).astype(np.int64), minlength=n * FEATURES)
    return out.reshape(n, FEATURES)


_SHAPE = mix(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)


def _owner(starts: np.ndarray, size: int) -> np.ndarray:
    """For each byte the start of the last word that began at or before it."""
    at = np.zeros(size, np.int64)
    at[starts] = starts
    return np.maximum.accumulate(at)


def repeats(texts: list[bytes]) -> np.ndarray:
    """The share of a text's words that are repeats, and of those next to their like; in EXTRA steps each (documents x 2)."""
    out = np.zeros((len(texts), 2))
    data = b" ".join(texts)
    h, starts, _ = hash_words(data)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    at = np.searchsorted(starts, first)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    near = np.zeros(len(h), bool)
    near[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    n = np.maximum(np.diff(at), 1)
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out[:, 0] = np.bincount(doc[order][same], minlength=len(texts)) / n
    out[:, 1] = np.bincount(doc[near], minlength=len(texts)) / n
    return out


def vectors(texts: list[bytes]) -> np.ndarray:
    """Term frequencies (square roots of shares) with two repeat features in the last places."""
    counts = features(texts)
    share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    share[:, -2:] = np.sqrt(repeats(texts))
    return share.astype(np.float32)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of features
    axes: np.ndarray  # FEATURES x RANK
    known: np.ndarray  # labelled vectors, RANK x labelled, of length 1
    label: np.ndarray  # their votes: 1 for good
    value: np.ndarray  # their weights

    def latent(self, texts: list[bytes]) -> np.ndarray:
        z = (vectors(texts) * self.weight) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.known.shape[1]:
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        for a in range(0, len(texts), BLOCKED):
            cosine = self.latent(texts[a : a + BLOCKED]) @ self.known
            k = min(NEAREST, cosine.shape[1])
            # ties with the last of the nearest vote too, so the order of labelled rows does not matter
            last = np.partition(cosine, -k, axis=1)[:, -k][:, None]
            vote = np.where(cosine >= last, np.maximum(cosine, 0.05).astype(np.float64), 0)
            for _ in range(3):
                vote *= vote
            vote *= self.value
            out[a : a + BLOCKED] = (vote @ self.label) / vote.sum(1)
        return np.clip(out, 0, 1)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; null keys don't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs (doc_id, text), labels (doc_id, quality) -> a model. Held-out and unlabelled rows, and labels but 0 and 1, aren't learned from.

    The inverse document frequencies are of all docs. Of labelled rows at most LABELLED are used, half of them of
    each label as far as there are, by the least hashes of their ids; of several labels of an id the least counts."""
    width = FEATURES

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(width, np.int64), 0
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in slices(texts):
                held += (features(texts[a:b]) > 0).sum(0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array([*range(width), width]), pa.array([*held.tolist(), n])], names=["f", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    held = np.zeros(width + 1)
    for f, n in texts.mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows
        held[f] = n
    weight = (np.log((1 + held[width]) / (1 + held[:width])) + 1).astype(np.float32)
    weight[-2:] = 4.0

    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out())
    picked = [marked.filter(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED // 2) for q in (0, 1)]
    sample = docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("doc_id", F.col("text").cast("string").alias("text"), "quality")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = utf8(batch["text"])
            for a, b in slices(t):
                x = vectors(t[a:b]) * weight
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["quality"].slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    rows = sorted(sample.mapInArrow(project, "doc_id long, quality int, x binary").dropDuplicates(["doc_id"]).collect())  # at most LABELLED rows of FEATURES floats
    if not rows:
        return Model(weight, np.zeros((width, RANK), np.float32), np.zeros((RANK, 0), np.float32), np.zeros(0), np.zeros(0))
    x = np.stack([np.frombuffer(r[2], np.float32) for r in rows])
    _, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :RANK]).astype(np.float32)
    z = x @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    label = np.array([float(r[1]) for r in rows])
    share = np.array([max((label == q).mean(), 1e-9) for q in (0, 1)])
    return Model(weight, axes, np.ascontiguousarray(z.T), label, 1 / share[label.astype(int)])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (text, more) -> the columns of keep (all by default) and score, from 0 to 1: higher, likelier good.

    Null texts are scored as empty: nothing is nearest, all labelled rows vote alike. Repeated rows score alike, an empty table
    gives an empty result. A column named score is replaced. One row for each row."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = extended(docs, kept, "score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in kept), pa.array(known.score(texts[a:b]))], names=[*kept, "score"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)
