"""Quality rules: line-first cleaning.

Each line is judged by itself: a line that does not end as a sentence does (in any script that marks
sentences), a navigation bar, a line of which boilerplate phrases make up an eighth or more of the words,
one of symbols or of shouting, or a repeat of an earlier line goes. Prose that only mentions such a phrase stays. A document
that loses more than half of its characters in words to that is rejected, as is one that fails the
base rules (under 50 words, or more than half of its words in repeated 3-word windows).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._tables import extended
from ._text import _SEP, grams, hash_words, mix, slices, utf8

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"

# Fixed values of the line rules.
TERMINALS = "։؝؞؟۔܀܁܂।॥၊။።፧፨᙮។៕᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⸮。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗！．？｡"  # ends of sentences beyond ASCII
ENDS = tuple(x.encode() for x in (".", "!", "?", ":", ";", '"', "'", ")", "]", "…", "”", "’", "»", *TERMINALS))
UNMARKED = ((0x0E00, 0x0EFF),)  # Thai and Lao don't mark the ends of sentences
INNER = (b". ", b"! ", b"? ", *(x.encode() for x in TERMINALS))  # a line with a sentence's end inside is prose, however it ends
BARS = (b"|", b">", b"/", "»".encode(), "•".encode(), "·".encode())
BOILERPLATE = (
    b"all rights reserved", b"licensed under", b"released under the", b"copyright (c)",
    b"terms of use", b"terms of service", b"privacy policy", b"cookie policy", b"we use cookies", b"accept cookies",
    b"click here", b"read more", b"sign up", b"log in", b"subscribe to", b"skip to content", b"back to top",
    b"enable javascript", b"javascript is disabled", b"share this", b"follow us on", b"lorem ipsum",
)

_PHRASES = re.compile(rb"(?<![a-z0-9\x80-\xff])(" + b"|".join(map(re.escape, BOILERPLATE)) + rb")(?![a-z0-9\x80-\xff])")
_INNER = re.compile(b"|".join(map(re.escape, INNER)))

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_passes(line: bytes, plain: bool) -> bool:
    """Whether a line with a word stays; plain: it has no symbol and no exclamation mark."""
    line = line.strip(BLANKS)
    if not line.endswith(ENDS) and not _INNER.search(line) and not any(a <= ord(line[-4:].decode(errors="ignore")[-1]) <= b for a, b in UNMARKED):
        return False
    if not plain:
        words = line.split()  # bytes.split() parts at space and tab..CR
        if 2 * sum(w.endswith(b"!!") for w in words) >= len(words) or 5 * sum(w in BARS for w in words) >= len(words):
            return False
        if 10 * sum(map(line.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))) >= sum(len(w.decode()) for w in words):
            return False
    found = set(_PHRASES.findall(line.lower()))  # bytes: A-Z only
    return not found or 8 * sum(len(p.split()) for p in found) < len(line.split())


def clean(text: bytes) -> tuple[bytes, int, int]:
    """The text without failing lines, the characters in words that stay, and how many lines repeat an earlier one."""
    plain = not any(s in text for s in (b"|", b"#", b"*", b"$", b"%", b"&", b"<", b">", b"!!", b"/", "»".encode(), "•".encode(), "·".encode()))
    seen: set[bytes] = set()
    keep, chars, repeats = [], 0, 0
    for line in text.split(b"\n"):
        bare = line.strip(BLANKS)
        if not bare:
            keep.append(line)
        elif line in seen:
            repeats += 1
        else:
            seen.add(line)
            if line_passes(line, plain):
                keep.append(line)
                chars += len(line.translate(None, BLANKS).decode())
    return b"\n".join(keep), chars, repeats


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of each text; n_dup_lines is left to clean()."""
    data = b" ".join(texts)
    h, starts, _ = hash_words(data)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    at = np.searchsorted(starts, first)
    n = np.diff(at)
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[0], np.cumsum(~_SEP[b] & ((b & 0xC0) != 0x80))])
    signs = np.concatenate([[0], np.cumsum(np.isin(b, np.frombuffer(SYMBOLS, np.uint8)))])
    edge = np.minimum(first, len(data))
    doc = np.repeat(np.arange(len(texts)), n)
    window = np.zeros(len(h), bool)
    left = at[1:][doc] - np.arange(len(h)) if len(h) else np.empty(0, np.int64)
    whole = np.flatnonzero(left >= 3)
    key = mix(grams(h, 3)[whole] + doc[whole].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), 21)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(whole), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    window[whole[again]] = True
    cover = window.copy()
    cover[1:] |= window[:-1]
    cover[2:] |= window[:-2]
    covered = np.concatenate([[0], np.cumsum(cover)])
    return {"n_words": n, "word_chars": inside[edge[1:]] - inside[edge[:-1]], "n_symbols": signs[edge[1:]] - signs[edge[:-1]], "n_repeat_words": covered[at[1:]] - covered[at[:-1]]}


def judge(docs: DataFrame, keep: list[str] | None = None, text: str | None = None) -> DataFrame:
    """docs (text, more) -> the columns of keep (all by default), the base counts, base_failed and kept.

    text names a column to put the cleaned text in (it may replace a column). Null texts have no words
    and fail. Columns of the names that are added are replaced. One row for each row, repeats included."""
    added = [*STATS, "base_failed", "kept", *([text] if text else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = extended(docs, kept, ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean" + (f", {text} string" if text else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in slices(texts):
                s = statistics(texts[a:b])
                cleaned = [clean(t) for t in texts[a:b]]
                s["n_dup_lines"] = np.array([c[2] for c in cleaned])
                failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                stays = ~failed & (2 * np.array([c[1] for c in cleaned]) >= s["word_chars"])
                out = [*(batch[c].slice(a, b - a) for c in kept), *(pa.array(s[c], pa.int64()) for c in STATS), pa.array(failed), pa.array(stays)]
                if text:
                    out.append(pa.array([c[0] for c in cleaned], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def oracle(table: str = "documents") -> str:
    """The same judgement in DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]+"
    quoted = lambda xs: ", ".join("'" + x.decode().replace("'", "''") + "'" for x in xs)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM {table}),
    win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
    rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM win),
    cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE n > 1) GROUP BY doc_id),
    line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
    wl AS (SELECT doc_id, line, i, regexp_extract_all(line, '{word}') AS w FROM line WHERE regexp_matches(line, '{word}')),
    rl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again, list_sum(list_transform(w, lambda x: length(x))) AS chars FROM wl),
    jl AS (SELECT *, NOT again
        AND (len(list_filter([{quoted(ENDS)}], lambda e: ends_with(w[-1], e))) > 0 OR regexp_matches(line, '[.!?] .*{word}') OR regexp_matches(line, '[{TERMINALS}]')
            OR regexp_matches(w[-1], '[{"".join(f"{chr(a)}-{chr(b)}" for a, b in UNMARKED)}]$'))
        AND 2 * len(list_filter(w, lambda x: ends_with(x, '!!'))) < len(w)
        AND 5 * len(list_filter(w, lambda x: list_contains([{quoted(BARS)}], x))) < len(w)
        AND 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) < chars
        AND coalesce(nullif(8 * list_sum(list_transform(list_filter([{quoted(BOILERPLATE)}],
            lambda p: regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])' || regexp_escape(p) || '($|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])')),
            lambda p: len(string_split(p, ' ')))), 0) < len(w), TRUE) AS good FROM rl),
    per AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE good), 0) AS stay FROM jl GROUP BY doc_id),
    s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stay, 0) AS stay
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN per USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * stay >= word_chars AS kept FROM s"""
