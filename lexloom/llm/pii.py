"""PII: weak-supervision aggregation.

Wide patterns propose candidate spans; labelers of three sorts vote on each (for, against or
abstaining): strict patterns and check sums, gazetteers, and context. The vote vectors of the whole
corpus are counted in Spark; expectation-maximisation over these counts (a fixed number of distinct
vectors, whatever the corpus) estimates each labeler's reliability for each kind without labels. The posteriors
then train a logistic span classifier, and it decides the final spans. Its inputs are kind and votes and what
no labeler sees: the words before and after a span, its length and its runs of character classes (hashed).
It is fitted on a sample of at most SAMPLED candidates, those of least hashes of what they are.

Spans of the base patterns are always kept; the classifier adds others. Where an added span would
overlap a base span or an earlier added one, it is left out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch, extended

KINDS = ("email", "ip", "card", "phone", "id", "secret")
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"
CONTEXT = 40  # characters before a span that context labelers see
SAMPLED, HASHED = 20_000, 512  # candidates that the classifier is fitted on, at most; hashed inputs of the classifier

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# candidates beyond the base patterns
_MORE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]+)+", re.I), re.compile(r"[\[({]at[\])}]", re.I)),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"), None),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), None),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), None),
    ("secret", re.compile(r"(?:password|passwd|secret|token|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?(?P<s>[A-Za-z0-9+/_.-]{6,})", re.I), re.compile(r"[=:]")),
)
# Gazetteers and context words by kind.
TLDS = frozenset("com org net edu gov mil int info biz io dev app co uk de fr es it nl be ch at se no dk fi pl pt ie eu us ca mx br ar cl au nz jp cn kr in ru ua tr za".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "62")
FOR = {
    "email": ("mail", "email", "contact", "write", "reach", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "adresse", "client"),
    "card": ("card", "visa", "master", "credit", "payment", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp"),
    "id": ("ssn", "social", "security", "insurance", "id"), "secret": ("key", "password", "secret", "token", "aws", "credential", "auth"),
}
AGAINST = ("version", "release", "isbn", "issn", "page", "figure", "table", "section", "example:", "doi", "order", "invoice")
_WORD = re.compile(r"[a-z:]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_ok(kind: str, s: str) -> bool:
    """The check that a match of a base pattern has to pass."""
    if kind == "ip":
        return all(int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the check passes) of the base patterns."""
    out = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end(), base_ok(kind, m[0])) for m in pattern.finditer(text) if kind != "card" or m.end() - m.start() >= 13]
    return out


def _two_cards(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """A failed card match as two numbers of 16 digits, if both pass the check, else as it is."""
    places = [i for i in range(a, b) if "0" <= text[i] <= "9"] if b - a <= 72 else []
    parts = [("card", places[0], places[15] + 1), ("card", places[16], places[31] + 1)] if len(places) == 32 else []
    return parts if parts and all(luhn(_digits(text[i:j])) for _, i, j in parts) else [("card", a, b)]


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base matches, flagged, and further candidates that don't overlap those that pass; by kind and start."""
    found = matches(text)
    more = [part for k, a, b, ok in found if not ok for part in (_two_cards(text, a, b) if k == "card" else [(k, a, b)])]
    for kind, pattern, needs in _MORE:
        if needs is None or needs.search(text):
            more += [(kind, *(m.span("s") if "s" in pattern.groupindex else m.span())) for m in pattern.finditer(text)]
    out = [x for x in found if x[3]]
    # candidates come by start, so an earlier one overlaps if it ends later; base spans are merged to disjoint ones and searched
    starts, ends, done = [], [], 0
    for a, b in sorted((a, b) for _, a, b, ok in found if ok):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, a, b in sorted(more, key=lambda x: (x[1], -x[2], x[0])):
        i = bisect_right(ends, a)
        if a >= done and (i == len(ends) or starts[i] >= b):
            done = b
            out.append((kind, a, b, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def votes(text: str, kind: str, a: int, b: int, ok: bool) -> tuple[int, ...]:
    """Votes (1, -1, 0) of the labelers: pattern, gazetteer, context, edges, shape."""
    s, low = text[a:b], text[max(0, a - CONTEXT) : a].lower()
    digits = _digits(s)
    if kind in ("ip", "card"):
        pattern = 1 if base_ok(kind, s) else -1
    elif kind in ("email", "phone"):
        pattern = 1 if ok else 0
    else:
        pattern = 1 if kind == "id" or s.startswith(("AKIA", "ASIA")) else 0
    if kind == "email":
        last = re.split(r"[^a-z]+", s.lower())[-1]
        gazetteer = 1 if last in TLDS else -1
    elif kind == "phone":
        gazetteer = 1 if any(digits.startswith(c) for c in CALLING_CODES) and s.startswith("+") else 0 if digits[:1] not in "01" else -1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif kind == "ip":
        gazetteer = -1 if s.split(".")[0] in ("0", "255") or s in ("127.0.0.1", "1.1.1.1") else 1
    elif kind == "id":
        gazetteer = -1 if s.startswith(("000", "666", "9")) or s[4:6] == "00" or s.endswith("0000") else 1
    else:
        gazetteer = 1 if s.startswith(("AKIA", "ASIA")) else 0
    words = _WORD.findall(low)
    # short context words are whole words, longer ones may go on (mastercard, hostname)
    names = lambda w: any(w.strip(":") == c or (len(c) > 3 and w.startswith(c)) for c in FOR[kind])
    context = 1 if any(map(names, words)) else -1 if set(words) & set(AGAINST) else 0
    beside = (text[a - 1] if a else " ") + (text[b] if b < len(text) else " ")
    edges = -1 if any(c.isalnum() or c == "_" for c in beside) else 1
    distinct = len(set(digits)) if kind != "secret" else len(set(s))
    shape = 1 if distinct >= (4 if kind != "email" else 0) else -1
    return pattern, gazetteer, context, edges, shape


LABELERS = 5


def traits(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """Hashed inputs of the classifier: two words before a span and one after, its length and its shape."""
    before, after, s = text[max(0, a - CONTEXT) : a].lower().split()[-2:], text[b : b + CONTEXT // 2].lower().split()[:1], text[a:b]
    shape = re.sub(r"(.)\1+", r"\1", "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in s[:CONTEXT]))
    named = [*(f"b{w}" for w in before), *(f"a{w}" for w in after), f"n{min(12, (b - a) // 4)}", f"s{shape}"]
    return tuple(sorted({zlib.crc32(f"{kind}:{x}".encode()) % HASHED for x in named}))


@dataclass(frozen=True)
class Model:
    """Priors by kind and the span classifier: a weight for each kind, for each vote of each labeler, and for each hashed input."""

    prior: tuple[float, ...] = (0.5,) * len(KINDS)
    kind: tuple[float, ...] = (0.0,) * len(KINDS)
    vote: tuple[tuple[float, float, float], ...] = ((-3.0, 0.0, 1.0), *((-1.0, 0.0, 1.0),) * (LABELERS - 1))  # a failed check counts most
    trait: tuple[float, ...] = (0.0,) * HASHED

    def score(self, kind: str, v: tuple[int, ...], seen: tuple[int, ...] = ()) -> float:
        z = self.kind[KINDS.index(kind)] + sum(w[x + 1] for w, x in zip(self.vote, v, strict=True)) + sum(self.trait[i] for i in seen)
        return float(1 / (1 + np.exp(-z)))


def reliabilities(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over counted vote vectors: prior by kind, P(vote | class) by kind and labeler, and the posterior of each vector."""
    start = np.array([[0.2, 0.3, 0.5], [0.5, 0.3, 0.2]])  # labelers do better than chance
    given = np.tile(start[:, None, None, :], (1, len(KINDS), LABELERS, 1))
    prior, labeler = np.full(len(KINDS), 0.5), np.arange(LABELERS)
    for _ in range(rounds):
        like = np.log(given[:, kind[:, None], labeler, v + 1]).sum(2)
        z = like[0] - like[1] + np.log(prior[kind]) - np.log1p(-prior[kind])
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for k in range(len(KINDS)):
            at = kind == k
            prior[k] = np.clip((n[at] @ post[at] + 1) / (n[at].sum() + 2), 0.01, 0.99)
        for c, p in ((0, n * post), (1, n * (1 - post))):
            hits = lambda at: np.stack([(p[at][:, None] * (v[at] == x)).sum(0) for x in (-1, 0, 1)], 1)  # noqa: B023, E731
            pooled = hits(np.full(len(n), True)) + start[c] * 4
            pooled /= pooled.sum(1, keepdims=True)
            for k in range(len(KINDS)):  # a kind with few candidates leans on all of them
                own = hits(kind == k) + pooled * 20
                given[c, k] = np.clip(own / own.sum(1, keepdims=True), 0.01, 0.98)
    return prior, given, post


def train(kind: np.ndarray, v: np.ndarray, n: np.ndarray, sample: list[tuple[tuple[int, ...], tuple[int, ...], int]] = ()) -> Model:
    """Logistic regression on the posteriors of counted vote vectors by gradient steps of fixed number.

    sample: (kind and votes, hashed inputs, how many candidates have these); without one, the vectors themselves are learned from, by their counts."""
    if not len(n):
        return Model()
    prior, _, post = reliabilities(kind, v, n)
    at = {(k, *row): i for i, (k, row) in enumerate(zip(kind.tolist(), v.tolist(), strict=True))}
    rows = np.array([at[key] for key, _, _ in sample] or np.arange(len(n)), int)
    share = np.array([times for _, _, times in sample], float) if len(sample) else n
    share = share / share.sum()
    seen = np.zeros((len(rows), HASHED))
    for i, (_, traits_, _) in enumerate(sample):
        seen[i, list(traits_)] = 1
    x = np.concatenate([np.eye(len(KINDS))[kind[rows]], *(np.eye(3)[v[rows, j] + 1] for j in range(LABELERS)), seen], axis=1)
    start, post = Model(), post[rows]
    w = np.concatenate([start.kind, *(np.array(t) for t in start.vote), start.trait])
    first = w.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ (share * (p - post)) + 1e-3 * (w - first))
    k, m = len(KINDS), len(KINDS) + 3 * LABELERS
    return Model(tuple(prior.tolist()), tuple(w[:k].tolist()), tuple(tuple(w[k + 3 * j : k + 3 * j + 3].tolist()) for j in range(LABELERS)), tuple(w[m:].tolist()))


def fit(docs: DataFrame) -> Model:
    """Learn from the votes on all candidates of docs (text); null texts have none, repeated rows count, an empty table gives the start model.

    What the driver gets has at most 6 * 3^5 rows of counts and SAMPLED candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *votes(t, k, a, b, ok), traits(t, k, a, b)) for t in batch["text"].to_pylist() if t for k, a, b, ok in candidates(t)]
            kinds, *columns, seen = zip(*rows, strict=True) if rows else [()] * (LABELERS + 2)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *(pa.array(c, pa.int32()) for c in columns), pa.array(seen, pa.list_(pa.int32()))], names=["kind", *names, "seen"])

    names = [f"v{i}" for i in range(LABELERS)]
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, " + ", ".join(f"{c} int" for c in names) + ", seen array<int>")
    # candidates alone are written: the texts are read once
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(found.groupBy("kind", *names, "seen").agg(F.count("*").alias("n")))
    rows = sorted(found.groupBy("kind", *names).agg(F.sum("n").alias("n")).collect())
    picked = found.withColumn("h", F.xxhash64("kind", *names, "seen")).orderBy("h", "kind", *names, "seen").limit(SAMPLED).collect()
    scratch.keep_only()
    sample = [((KINDS.index(r[0]), *r[1 : 1 + LABELERS]), tuple(r["seen"]), r["n"]) for r in picked]
    return train(np.array([KINDS.index(r[0]) for r in rows], int), np.array([r[1:-1] for r in rows], int).reshape(len(rows), LABELERS), np.array([r[-1] for r in rows], float), sample)


def find(docs: DataFrame, model: Model, keep: list[str] | None = None, redact: bool = False, least: float = 0.5) -> DataFrame:
    """docs (text, more) -> the columns of keep (all by default) and spans, by kind in the order of KINDS, then start.

    Starts and ends are in code points, ends exclusive. Added spans score at least `least`. With redact, each
    span of text is replaced by its kind in angle brackets (of overlapping ones the earlier, then longer one's).
    Null texts stay null and have no spans. A column named spans is replaced. One row for each row."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    schema = extended(docs, kept, f"spans {SPANS}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], []
            for t in batch["text"].to_pylist():
                spans = []
                for k, a, b, ok in candidates(t) if t else ():
                    score = model.score(k, votes(t, k, a, b, ok), traits(t, k, a, b))
                    if ok or score >= least:
                        spans.append({"kind": k, "start": a, "end": b, "base": ok, "score": score})
                out.append(spans)
                if redact:
                    parts, done = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= done:
                            parts += [t[done : s["start"]], f"<{s['kind'].upper()}>"]
                            done = s["end"]
                        elif s["end"] > done:  # the rest of an overlapping span goes too
                            done = s["end"]
                    texts.append("".join([*parts, t[done:]]) if spans else t)
            columns = [pa.array(texts, pa.string()) if c == "text" and redact else batch[c] for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[*kept, "spans"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def span_list(spans: str | F.Column, base: bool = False) -> F.Column:
    """Spans as kind:start:end, joined by commas; base: those of the base patterns alone."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    if base:
        spans = F.filter(spans, lambda s: s["base"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
