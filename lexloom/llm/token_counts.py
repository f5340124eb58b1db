"""Token counts: edit-aware counting with a segment tree of pre-tokens per document.

A document's leaves are runs of pre-tokens between certain cuts (see bpe), so its count is the sum
of its leaves' counts. The tree is kept as two arrays in heap order: characters and tokens under
each node. An edit descends by characters to the leaves it touches, adds a neighbour where the edit
reaches the context of a cut, re-encodes that stretch alone and updates the sums on the way up.

The strings of added tokens count as ordinary text here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, Vocabulary, default_vocabulary, merged, vocabulary
from ._tables import extended
from ._text import slices, utf8

#: Fragments in a leaf at first; a tree is built anew when a leaf has grown to GROWN times as many characters as the mean leaf.
LEAF, GROWN = 32, 16
TOGETHER = 2000  # edits whose stretches are encoded together
EDITS = "array<struct<at: int, removed: int, inserted: string>>"


def _sums(leaves: np.ndarray) -> np.ndarray:
    """Heap of 2 * width entries; node i has children 2i and 2i+1, leaves are the last width entries."""
    width = 1 << max(0, int(len(leaves) - 1).bit_length())
    heap = np.zeros(2 * width, np.int64)
    heap[width : width + len(leaves)] = leaves
    while width > 1:
        level = heap[width : 2 * width]
        width //= 2
        heap[width : 2 * width] = level[0::2] + level[1::2]
    return heap


def build(known: Vocabulary, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's heaps of characters and of tokens."""
    data = b"".join(texts)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    at = merged(known.cuts(data), begin)
    which, _, sizes = known.pieces(data, at)
    size = np.concatenate([[0], np.cumsum(sizes[which])])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[at]
    out = []
    for a, b in zip(np.searchsorted(at, begin[:-1]), np.searchsorted(at, begin[1:]), strict=True):
        edge = np.append(np.arange(a, b, LEAF), b)
        out.append((_sums(np.diff(chars[edge])), _sums(np.diff(size[edge]))))
    return out


def _descend(heap: list[int], at: int) -> tuple[int, int]:
    """The leaf that holds character at (the last one that has any, past the end) and the characters before it."""
    i, before, width = 1, 0, len(heap) // 2
    at = min(at, heap[1] - 1)
    while i < width:
        i *= 2
        if at - before >= heap[i]:
            before += heap[i]
            i += 1
    return i, before


def _set(heap: list[int], i: int, value: int) -> None:
    change = value - heap[i]
    while change and i:
        heap[i] += change
        i //= 2


Tree = tuple[str, list[int], list[int]]  # text, heap of characters, heap of tokens


def edit(known: Vocabulary, trees: list[Tree], edits: list[tuple[int, int, str]]) -> tuple[list[Tree], list[int]]:
    """One edit (at, removed, inserted; clipped to the text) of each tree: the trees after it, and how many characters of each were encoded.

    The stretches that the edits touch are encoded together."""
    out: list[Tree] = []
    part, place = [], []
    for (text, chars, tokens), (at, removed, inserted) in zip(trees, edits, strict=True):
        at = max(0, min(at, len(text)))
        end = at + max(0, min(removed, len(text) - at))
        new = text[:at] + inserted + text[end:]
        if text:
            # a cut depends on the characters on both sides of it: take in the leaves of those beside the edit
            first, start = _descend(chars, max(0, at - 1))
            last, before = _descend(chars, end)
            part.append(text[start:at] + inserted + text[end : before + chars[last]])
        else:
            first, last = 1, len(chars) - 1
            part.append(new)
        place.append((first, last))
        out.append((new, chars, tokens))
    data = [p.encode() for p in part]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    joined = b"".join(data)
    at = merged(known.cuts(joined), begin)
    which, _, sizes = known.pieces(joined, at)
    upto = np.concatenate([[0], np.cumsum(sizes[which])])[np.searchsorted(at, begin)]
    counts = np.diff(upto).tolist()
    grown = []
    for i, (new, chars, tokens) in enumerate(out):
        first, last = place[i]
        if first == 1:  # the text was empty: all of it is its first leaf
            first = len(chars) // 2
            last = first
        for leaf in range(first + 1, last + 1):
            _set(chars, leaf, 0)
            _set(tokens, leaf, 0)
        _set(chars, first, len(part[i]))
        _set(tokens, first, counts[i])
        if len(part[i]) * (len(chars) // 2) > GROWN * max(len(new), 64 * LEAF):
            grown.append(i)
    encoded = [len(p) for p in part]
    for i, (c, t) in zip(grown, build(known, [out[i][0].encode() for i in grown]) if grown else (), strict=True):
        out[i] = (out[i][0], c.tolist(), t.tolist())
        encoded[i] += len(out[i][0])
    return out, encoded


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (text, more) -> the same columns, n_tokens, and the tree: char_sums and token_sums in heap order.

    Null texts count as empty and stay null, however long texts are encoded in pieces; repeated rows stay, each with its tree; an empty table gives
    an empty result. Columns of those three names are replaced."""
    path = path or default_vocabulary()
    kept = [c for c in docs.columns if c not in ("n_tokens", "char_sums", "token_sums")]
    schema = extended(docs, kept, "n_tokens long, char_sums array<long>, token_sums array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, False)
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in slices(texts, ENCODED_BYTES):
                trees = build(known, texts[a:b])
                sums = [pa.array([t[i] for t in trees], pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in kept), pa.array([int(t[1][1]) for t in trees], pa.int64()), *sums], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def apply_edits(counted: DataFrame, path: str | None = None) -> DataFrame:
    """counted (text, n_tokens, char_sums, token_sums, edits, more) -> the same with text, count and tree after
    the edits, in their order, and n_encoded: the characters that were encoded again.

    edits is an array of (at, removed, inserted) in characters, each upon the text that the one before left; null
    edits or parts of them do nothing. A column named n_encoded is replaced. Repeated rows stay; an empty table gives an empty result."""
    path = path or default_vocabulary()
    kept = [c for c in counted.columns if c not in ("n_encoded", "text", "n_tokens", "char_sums", "token_sums")]
    names = ["text", "n_tokens", "char_sums", "token_sums", "n_encoded"]
    schema = extended(counted, [*kept, *names[:4]], "n_encoded long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, False)
        for batch in batches:
            texts = batch["text"].to_pylist()
            trees = list(zip([t or "" for t in texts], batch["char_sums"].to_pylist(), batch["token_sums"].to_pylist(), strict=True))
            edits = [[(e["at"] or 0, e["removed"] or 0, e["inserted"] or "") for e in es or () if e and (e["removed"] or e["inserted"])] for es in batch["edits"].to_pylist()]
            encoded = [0] * len(trees)
            for k in range(max(map(len, edits), default=0)):
                todo = [i for i, es in enumerate(edits) if len(es) > k]
                for a in range(0, len(todo), TOGETHER):
                    some = todo[a : a + TOGETHER]
                    done, n = edit(known, [trees[i] for i in some], [edits[i][k] for i in some])
                    for i, tree, m in zip(some, done, n, strict=True):
                        trees[i], encoded[i] = tree, encoded[i] + m
            void = [t is None and not es for t, es in zip(texts, edits, strict=True)]
            columns = [
                pa.array([None if v else t[0] for v, t in zip(void, trees, strict=True)], pa.string()), pa.array([t[2][1] for t in trees], pa.int64()),
                pa.array([t[1] for t in trees], pa.list_(pa.int64())), pa.array([t[2] for t in trees], pa.list_(pa.int64())), pa.array(encoded, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], names=[*kept, *names])

    return counted.select(*kept, *names[:4]).mapInArrow(run, schema)


def sample_edits(text: str = "text") -> F.Column:
    """Three edits for each document: a passage of its own moved in at a quarter, some words cut at the middle, and a line at its end."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    own = F.coalesce(F.substring(text, 11, 60), F.lit(""))
    part = lambda at, removed, inserted: F.struct(at.cast("int").alias("at"), removed.cast("int").alias("removed"), inserted.alias("inserted"))
    return F.array(part(F.floor(n / 4), F.lit(0), own), part(F.floor(n / 2), F.lit(37), F.lit("")), part(n + 60, F.lit(0), F.lit("\nRevised 2024-05-17."))).cast(EDITS)
