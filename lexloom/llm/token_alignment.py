"""Cross-tokenizer alignment: groups of tokens of two tokenizers over the same bytes, and how often their ids meet.

A text is encoded by a byte-level BPE file (side A, with a space before the text) and by a sentencepiece model (side B, which adds
that space itself). Places where tokens of both sides end cut the text into groups; every A token of a group is linked with every
B token of it. The count of a pair of ids is the number of documents that hold it linked.

Counting is external. Tasks write their documents' pairs as runs: by radix of the A id, sorted by (A id, B id, document), in
zstd. Bounded numbers of runs of one radix are merged by a heap, which counts the documents of each pair; partial counts are few (at
most one for a pair and merge) and Spark adds them. In the order of side A the greatest count of each A id follows, and the counted
pairs, packed in the runs' order, meet the runs once more and stream each document's contributions back. Pairs that very many
documents hold are one partial count in each run, so no task gets all documents of a pair.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._tables import Scratch, extended
from ._text import fragment_names, slices, utf8

#: Runs by A id; runs merged at once; records of a frame; counted pairs packed together.
RADIX, FAN, FRAME, PACKED = 32, 64, 1 << 14, 1 << 15
#: Bytes of text whose pairs make one run for each radix; pairs of tokens looked at together.
RUN_BYTES, TOGETHER = 1 << 22, 1 << 21
#: Distinct fragments of side B that a worker remembers before it begins anew.
REMEMBERED = 400_000
DIGESTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A sentencepiece model whose pieces hold spaces at their beginnings only, so that texts may be cut before single spaces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cut = not any(" " in p.replace("▁", " ").lstrip(" ") for p in names)
        self._forget()

    def _forget(self) -> None:
        # fragments by their two names, sorted by the first: bytes of text, sizes and beginnings of their ids in flat
        self.name, self.other, self.length = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, data: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: texts, each with a space before it, that begin at `begin` (its last is the end) -> all ids in a row, and where each text's begin."""
        b = np.frombuffer(data, np.uint8)
        at = begin
        if self.cut and len(b) > 2:
            one = np.flatnonzero((b[1:-1] == 0x20) & (b[:-2] != 0x20) & (b[2:] != 0x20)) + 1
            at = bpe.merged(one.astype(np.int64), begin)
        name, other = fragment_names(data, at)
        length = np.diff(at)
        if len(self.name) > REMEMBERED:
            self._forget()
        fresh, first = np.unique(name, return_index=True)
        place = np.minimum(np.searchsorted(self.name, fresh), max(0, len(self.name) - 1))
        new = first if not len(self.name) else first[self.name[place] != fresh]
        self._learn([data[i + 1 : i + n] for i, n in zip(at[:-1][new].tolist(), length[new].tolist(), strict=True)], name[new], other[new], length[new])
        which = np.searchsorted(self.name, name)
        if (self.other[which] != other).any() or (self.length[which] != length).any():  # two fragments with one name
            self._forget()
            ids = self.model.encode([data[i + 1 : j].decode() for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], num_threads=1)
            return np.fromiter(chain.from_iterable(ids), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        out = self.flat[bpe.ragged(self.start[which], self.size[which])]
        return out, np.concatenate([[0], np.cumsum(self.size[which])])[np.searchsorted(at, begin)]

    def _learn(self, fragments: list[bytes], name: np.ndarray, other: np.ndarray, length: np.ndarray) -> None:
        flat, sizes = [self.flat], []
        for a in range(0, len(fragments), 2000):
            ids = self.model.encode([f.decode() for f in fragments[a : a + 2000]], num_threads=1)
            sizes += map(len, ids)
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
        size = np.array(sizes, np.int64)
        start = len(self.flat) + np.cumsum(size) - size
        order = np.argsort(np.concatenate([self.name, name]), kind="stable")
        self.flat = np.concatenate(flat)
        for field, more in (("name", name), ("other", other), ("length", length), ("size", size), ("start", start)):
            setattr(self, field, np.concatenate([getattr(self, field), more])[order])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts' bytes in a row, where each begins and how many it has."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


@lru_cache(maxsize=2)
def _tables(a_path: str, b_path: str) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Bytes of A's tokens, of B's pieces, and decimal digits of ids."""
    a, b = bpe.vocabulary(a_path, False).bytes, pieces(b_path).bytes
    return _flat(a), _flat(b), _flat([str(i).encode() for i in range(max(len(a), len(b)))])


def _gives_back(table: tuple[np.ndarray, ...], ids: np.ndarray, at: np.ndarray, data: bytes, begin: np.ndarray) -> np.ndarray:
    """For each text of data whether its tokens' bytes are the text."""
    flat, start, size = table
    n = size[ids]
    upto = np.concatenate([[0], np.cumsum(n)])[at]
    same = np.diff(upto) == np.diff(begin)
    keep = np.repeat(same, np.diff(at))
    made = flat[bpe.ragged(start[ids[keep]], n[keep])]
    wrong = np.flatnonzero(made != np.frombuffer(data, np.uint8)[np.repeat(same, np.diff(begin))])
    ends = np.cumsum(np.diff(begin)[same])
    same[np.flatnonzero(same)[np.searchsorted(ends, wrong, side="right")]] = False
    return same


class Aligned:
    """The groups of some texts: ids of both sides in a row, and for each text and group where its tokens begin (one more at the end).

    Texts that are empty, or whose tokens on a side don't give back a space and the text, have no tokens."""

    def __init__(self, texts: list[bytes], a_path: str, b_path: str) -> None:
        side_a, side_b = bpe.vocabulary(a_path, False), pieces(b_path)
        of_a, of_b, self.digit = _tables(a_path, b_path)
        self.n = len(texts)
        if len(self.digit[1]) > 1 << 20:
            raise ValueError("more than 1,048,576 ids")
        some = [i for i, t in enumerate(texts) if t]
        spaced = [b" " + texts[i] for i in some]
        begin = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
        data = b"".join(spaced)
        a, a_at = side_a.encode(spaced)
        b, b_at = side_b.encode(data, begin)
        a_size, b_size = of_a[2][a], of_b[2][b]
        good = _gives_back(of_a, a, a_at, data, begin) & _gives_back(of_b, b, b_at, data, begin)
        # of the good texts only: tokens, and the ends of tokens over all of them in a row
        keep_a, keep_b = np.repeat(good, np.diff(a_at)), np.repeat(good, np.diff(b_at))
        self.a, self.b = a[keep_a], b[keep_b]
        a_end, b_end = np.cumsum(a_size[keep_a]), np.cumsum(b_size[keep_b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        self.a_group, self.b_group = np.concatenate([[0], np.searchsorted(a_end, common) + 1]), np.concatenate([[0], np.searchsorted(b_end, common) + 1])
        length = np.zeros(self.n, np.int64)
        length[np.array(some, np.int64)[good]] = np.diff(begin)[good]
        # texts without tokens get empty ranges
        self.text_group = np.concatenate([[0], np.searchsorted(common, np.cumsum(length), side="right")])
        self.a_text, self.b_text = self.a_group[self.text_group], self.b_group[self.text_group]

    def links(self) -> np.ndarray:
        """For each text, how many pairs of tokens are linked."""
        each = np.concatenate([[0], np.cumsum(np.diff(self.a_group) * np.diff(self.b_group))])
        return np.diff(each[self.text_group])

    def digests(self) -> list[str]:
        """For each text the SHA-256 of its groups, `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        digit, start, size = self.digit
        na, nb = np.diff(self.a_group), np.diff(self.b_group)
        place_a = np.arange(len(self.a)) + np.repeat(self.b_group[:-1], na)
        place_b = np.arange(len(self.b)) + np.repeat(self.a_group[1:], nb)
        token, mark = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        token[place_a], token[place_b] = self.a, self.b
        mark[place_a[self.a_group[1:] - 1]], mark[place_b[self.b_group[1:] - 1]] = ord("|"), ord(";")
        n = size[token]
        end = np.cumsum(n + 1)
        text = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        text[bpe.ragged(end - n - 1, n)] = digit[bpe.ragged(start[token], n)]
        text[end - 1] = mark
        at = np.concatenate([[0], end])[self.a_text + self.b_text].tolist()
        return [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (A id, B id, text) as a << 42 | b << 22 | text, sorted, and how often each is linked."""
        text = np.repeat(np.arange(self.n), np.diff(self.a_text))
        group = np.repeat(np.arange(len(self.a_group) - 1), np.diff(self.a_group))
        each = np.diff(self.b_group)[group]  # links of each A token
        upto = np.concatenate([[0], np.cumsum(each)])
        found, i = [], 0
        while i < len(each):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + TOGETHER, side="right")) - 1)
            b = self.b[bpe.ragged(self.b_group[group[i:j]], each[i:j])].astype(np.int64)
            found.append(np.unique(np.repeat(self.a[i:j].astype(np.int64) << 42 | text[i:j], each[i:j]) | b << 22, return_counts=True))
            i = j
        return _added(found)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys of some arrays of keys and numbers, and the sums of their numbers."""
    if len(found) < 2:
        return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, numbers = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(numbers[order], first)


# runs


def _pack(*columns: np.ndarray, kind: type = np.int64) -> bytes:
    """Columns of whole numbers in frames of FRAME records, zstd: each frame with its size before it. Of 64-bit columns the first is sorted and kept as steps."""
    press, out = zstandard.ZstdCompressor(level=1), []
    for i in range(0, len(columns[0]), FRAME):
        parts = [c[i : i + FRAME].astype(kind) for c in columns]
        if kind is np.int64:
            parts[0] = np.diff(parts[0], prepend=0)
        frame = press.compress(b"".join(p.tobytes() for p in parts))
        out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


def _frames(blob: bytes, columns: int, kind: type = np.int64) -> Iterator[list[np.ndarray]]:
    """The frames of a packed run, one at a time."""
    press, at = zstandard.ZstdDecompressor(), 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "little")
        parts = list(np.frombuffer(press.decompress(blob[at + 4 : at + 4 + size]), kind).reshape(columns, -1))
        if kind is np.int64:
            parts[0] = np.cumsum(parts[0])
        yield parts
        at += 4 + size


def _unpack(blob: bytes, columns: int, kind: type = np.int64) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*_frames(blob, columns, kind), strict=True)]


def merge(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed runs (sorted keys, numbers) -> sorted distinct keys with the sums of their numbers, in chunks.

    A heap holds for each run the last key of its open frame: up to the least of them every run's records are at hand."""
    left = [_frames(r, 2) for r in runs]
    open_frames = [next(f, None) for f in left]
    heap = [(int(f[0][-1]), k) for k, f in enumerate(open_frames) if f is not None]
    heapq.heapify(heap)
    while heap:
        last, _ = heap[0]
        found = []
        for k, f in enumerate(open_frames):
            if f is not None:
                n = int(np.searchsorted(f[0], last, side="right"))
                if n:
                    found.append((f[0][:n], f[1][:n]))
                    open_frames[k] = [f[0][n:], f[1][n:]]
        while heap and heap[0][0] == last:
            _, k = heapq.heappop(heap)
            open_frames[k] = next(left[k], None)
            if open_frames[k] is not None:
                heapq.heappush(heap, (int(open_frames[k][0][-1]), k))
        yield _added(found)


def _written(docs: DataFrame, kept: list[str], a_path: str, b_path: str, scratch: Scratch) -> DataFrame:
    """Rows of documents (row: a number of their own, kept columns, digests) and rows of runs (radix, row: that of the run's first document, pairs, held)."""
    schema = extended(docs, kept, f"{DIGESTS}, row long, radix int, pairs binary, held binary")
    docs_of = [*kept, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        types = {f.name: f.type for f in pa_schema}
        for batch in batches:
            texts = utf8(batch["text"])
            for i, j in slices(texts, RUN_BYTES):
                of = Aligned(texts[i:j], a_path, b_path)
                count = lambda at: pa.array(np.diff(at).astype(np.int64))
                cols = dict(zip(docs_of, [*(batch[c].slice(i, j - i).cast(types[c]) for c in kept), count(of.a_text), count(of.b_text), count(of.text_group), pa.array(of.links().astype(np.int64)), pa.array(of.digests()), pa.array(np.arange(row, row + j - i))], strict=True))
                yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(j - i, f.type)) for f in pa_schema], schema=pa_schema)
                key, n = of.pairs()
                at = ((key >> 42) * 0x9E3779B1 % (1 << 32) >> 16) % RADIX
                order = np.argsort(at.astype(np.uint8 if RADIX <= 256 else np.int64), kind="stable")
                key, n, ends = key[order], n[order], np.searchsorted(at[order], np.arange(RADIX + 1))
                for radix, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if a == b:
                        continue
                    pair = key[a:b] >> 22
                    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                    cols = {"radix": [radix], "row": [row], "pairs": [_pack(pair[first], np.diff([*first, b - a]))], "held": [_pack(key[a:b] & (1 << 22) - 1, n[a:b], kind=np.int32)]}
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(1, f.type) for f in pa_schema], schema=pa_schema)
                row += j - i

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    return scratch.save(docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema))


def _counted(runs: DataFrame) -> DataFrame:
    """Rows of runs -> radix, pair, n: in how many documents each pair is linked, and best: the most of its A id."""
    n = runs.select("row").distinct().count()
    group = F.pmod(F.xxhash64("row"), F.lit(-(-n // FAN) or 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            for key, number in merge(held):
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(key), pa.int32()), pa.array(key), pa.array(number)], names=["radix", "pair", "n"])

        for batch in batches:
            for radix, part, blob in zip(batch["radix"].to_pylist(), batch["part"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
                if held and (at != (radix, part) or len(held) >= FAN):
                    yield from flush()
                    held = []
                at = radix, part
                held.append(blob)
        if held:
            yield from flush()

    dealt = runs.select("radix", group.alias("part"), "pairs").repartition("radix", "part").sortWithinPartitions("radix", "part")
    partial = dealt.mapInArrow(count, "radix int, pair long, n long")
    return partial.groupBy("radix", "pair").agg(F.sum("n").alias("n"))


def _side(counted: DataFrame) -> DataFrame:
    """Counted pairs with best, the greatest count of each A id. An A id has no more pairs than side B has ids."""
    a = F.expr("pair >> 20").alias("a")
    return counted.select("*", a).join(counted.groupBy("radix", a).agg(F.max("n").alias("best")), ["radix", "a"])


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """docs (text) -> a_id, b_id, n_docs, best: in how many documents each pair of ids is linked, and the greatest number of the A id's pairs."""
    scratch = Scratch(docs.sparkSession, "pairs")
    rows = _written(docs, [], a_path or bpe.default_vocabulary(), b_path or default_pieces(), scratch)
    return _side(_counted(rows.filter("radix is not null"))).selectExpr("cast(a as int) a_id", "cast(pair & 1048575 as int) b_id", "n as n_docs", "best")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (text, more) -> the columns of keep (all by default), a_ids, b_ids, groups: an array of (a, b), how many tokens of each side a group has.

    Null and empty texts, and those that a side does not give back, have none. Columns of docs with these names are replaced."""
    made = ("a_ids", "b_ids", "groups")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = extended(docs, kept, "a_ids array<int>, b_ids array<int>, groups array<struct<a: int, b: int>>")
    a_path, b_path = a_path or bpe.default_vocabulary(), b_path or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            for i, j in slices(texts):
                of = Aligned(texts[i:j], a_path, b_path)
                pair = pa.StructArray.from_arrays([pa.array(np.diff(x).astype(np.int32)) for x in (of.a_group, of.b_group)], names=["a", "b"])
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values) for at, values in ((of.a_text, pa.array(of.a.astype(np.int32))), (of.b_text, pa.array(of.b.astype(np.int32))), (of.text_group, pair))]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in kept), *lists], names=[*kept, *made])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def weigh(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (text, more) -> the columns of keep (all by default), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair has the greatest count of its A id (ties included); count_sum: the sum of the counts of all links. Null and empty
    texts, and those whose tokens of a side don't give back a space and the text, have no tokens: zeros and ''. Rows stay as they are, each
    is a document of its own, repeated ones too; an empty table gives an empty result. Columns of docs with these names are replaced."""
    made = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "row", "radix", "pairs", "held")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = _written(docs, kept, a_path or bpe.default_vocabulary(), b_path or default_pieces(), scratch)
    runs = rows.filter("radix is not null")
    ordered = _side(_counted(runs)).repartitionByRange("radix", "pair").sortWithinPartitions("radix", "pair")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            radix = batch["radix"].to_numpy()
            edges = np.flatnonzero(np.diff(radix, prepend=radix[:1] - 1 if len(radix) else radix)).tolist() + [len(radix)]
            for i, j in ((x, min(x + PACKED, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) for x in range(a, b, PACKED)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array([int(radix[i])], pa.int32()), pa.array([_pack(*(part[c].to_numpy() for c in ("pair", "n", "best")))], pa.binary())], names=["radix", "counts"])

    packed = ordered.select("radix", "pair", "n", "best").mapInArrow(pack, "radix int, counts binary")
    packed = scratch.save(packed)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = lru_cache(maxsize=16)(lambda blob: _unpack(blob, 3))
        last, mine, held = None, [], []
        for batch in batches:
            for radix, first, pairs, own, counts in zip(*(batch[c] for c in ("radix", "row", "pairs", "held", "counts")), strict=True):
                pair, n, best = counted(counts.as_py())
                if last != (radix.as_py(), first.as_py()):  # a run's rows come together
                    last, mine, held = (radix.as_py(), first.as_py()), _unpack(pairs.as_py(), 2), _unpack(own.as_py(), 2, np.int32)
                a, b = np.searchsorted(mine[0], [pair[0], pair[-1] + 1])
                at = np.minimum(np.searchsorted(pair, mine[0][a:b]), len(pair) - 1)
                here = pair[at] == mine[0][a:b]
                size = mine[1][a:b]
                i, j = int(mine[1][:a].sum()), int(mine[1][:b].sum())
                text, linked = (x[i:j].astype(np.int64) for x in held)
                some = np.repeat(here, size)
                text, linked, at = text[some], linked[some], np.repeat(at, size)[some]
                if not len(text):
                    continue
                add = lambda weight: np.bincount(text, weight).astype(np.int64)  # noqa: B023, E731
                times, low = n[at], (1 << 24) - 1
                total = add(linked * (times & low)) + (add(linked * (times >> 24)) << 24)  # sums of doubles are whole below 2^53
                which = np.flatnonzero(np.bincount(text))
                yield pa.RecordBatch.from_arrays([pa.array(which + first.as_py()), pa.array(add(linked * (times == best[at]))[which]), pa.array(total[which])], names=["row", "n_best", "count_sum"])

    given = runs.select("radix", "row", "pairs", "held").join(packed, "radix").mapInArrow(give, "row long, n_best long, count_sum long")
    sums = given.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.filter("radix is null").join(sums, "row", "left").select(*kept, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
