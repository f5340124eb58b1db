"""Token ids of one segmentation for the morphemes of another.

Morphemes are matched from the left by rules of forms and tags. Where no rule fits, the walk has lost its step: the sentence is then cut at
anchors (forms that both sides have once, in the longest order that both share), and between anchors the fewest morphemes are left out.
A sentence is one row while it is matched, and each task's sentences go through Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of places between two anchors from which on their costs are found by whole rows (in arrays), and how many costs are then held at once. Both ways give the same.
CELLS, HELD = 2_500, 8_000_000
#: The tag of pronominal suffixes, of the prepositions that carry them, and forms of two particles.
SUFFIX, IN, PREPOSITION, PARTICLES, WITH_HER = "S_PRN", "IN", "PREPOSITION", {"EM", "AT"}, {"ATH", "AT"}


class Sides:
    """Forms and tags of the old and the new morphemes of a sentence; past the end they are None."""

    def __init__(self, old: list[tuple[str, str]], new: list[tuple[str, str]]) -> None:
        self.n_old, self.n_new = len(old), len(new)
        ends = [(None, None)] * 3
        self.of, self.ot = map(list, zip(*(old + ends), strict=True))
        self.nf, self.nt = map(list, zip(*(new + ends), strict=True))


def _spell(*forms: str | None) -> str | None:
    return None if None in forms else "".join(forms)  # type: ignore[arg-type]


def _start(s: Sides, i: int, j: int) -> bool:
    return s.nf[i][:3] == s.of[j][:3]


#: name, how many new and old morphemes it takes, and when it fits at new i and old j. The first that fits is taken; ids come from old j.
RULES = (
    ("equal", 1, 1, lambda s, i, j: s.nf[i] == s.of[j]),
    ("fused", 1, 2, lambda s, i, j: _spell(s.of[j], s.of[j + 1]) == s.nf[i]),
    ("fused_h", 1, 2, lambda s, i, j: len(s.of[j + 1] or "") > 1 and s.of[j] + s.of[j + 1][1:] == s.nf[i]),
    ("part", 1, 0, lambda s, i, j: _spell(s.nf[i], s.nf[i + 1]) == s.of[j]),
    ("rest", 1, 1, lambda s, i, j: i > 0 and s.nf[i - 1] + s.nf[i] == s.of[j]),
    ("old_suffix", 1, 2, lambda s, i, j: s.ot[j + 1] == SUFFIX and _start(s, i, j)),
    ("new_suffix", 2, 1, lambda s, i, j: s.nt[i + 1] == SUFFIX and _start(s, i, j)),
    ("pairs", 2, 2, lambda s, i, j: None is not _spell(s.nf[i], s.nf[i + 1]) == _spell(s.of[j], s.of[j + 1])),
    ("particles", 1, 1, lambda s, i, j: {s.nf[i][:3], s.of[j][:3]} == PARTICLES and s.nt[i + 1] == s.ot[j + 1] == SUFFIX),
    ("with_her", 1, 1, lambda s, i, j: {s.nf[i], s.of[j]} == WITH_HER and s.nt[i] == SUFFIX),
    ("in_suffix", 2, 1, lambda s, i, j: s.nt[i] == IN and s.nt[i + 1] == SUFFIX),
    ("b_suffix", 2, 2, lambda s, i, j: s.nf[i] == "B" and s.nt[i] == PREPOSITION and s.nf[i + 1] is not None and s.ot[j] == IN and s.ot[j + 1] == SUFFIX),
    ("three", 3, 1, lambda s, i, j: _spell(*s.nf[i : i + 3]) == s.of[j]),
    ("three_suffix", 3, 1, lambda s, i, j: s.nt[i + 1] == IN and s.nt[i + 2] == SUFFIX),
    ("around", 3, 1, lambda s, i, j: _spell(s.nf[i], s.nf[i + 2]) == s.of[j]),
    ("inner_h", 1, 0, lambda s, i, j: s.nf[i] == "H" and i > 0 and j > 0 and j + 1 < s.n_old and _spell(s.nf[i - 1], s.nf[i + 1]) == s.of[j - 1] + s.of[j]),
)


def _fits(s: Sides, i: int, j: int, end: int, old_end: int) -> Iterator[tuple[str, int, int]]:
    for name, takes, old, fits in RULES:
        if i + takes <= end and j + old <= old_end and fits(s, i, j):
            yield name, takes, old


def _from_left(s: Sides, i: int, end: int, j: int, old_end: int, out: list) -> bool:
    """Match new i to end - 1 with old j to old_end - 1, writing (old place, rule) to out; whether all are matched."""
    whole, new, of = True, s.nf, s.of
    while i < end:
        if j < old_end and new[i] == of[j]:  # the first rule, which fits most
            out[i] = j, "equal"
            i, j = i + 1, j + 1
            continue
        name, takes, old = next(_fits(s, i, j, end, old_end), ("none", 1, 0)) if j < old_end else ("none", 1, 0)
        for k in range(takes):
            out[i + k] = None if name == "none" else (j + (k if name == "pairs" else 0), name)
        whole &= name != "none"
        i, j = i + takes, j + old
    return whole


def _fewest_left_out(s: Sides, i: int, end: int, j: int, old_end: int, out: list) -> None:
    """The same so that the fewest morphemes of both sides are left out; of equally good ways the one with the earlier rule, then without the new morpheme."""
    width = old_end - j + 1
    cost = [[0] * width for _ in range(end - i + 1)]
    pick: list[list[tuple]] = [[("end", 0, 0)] * width for _ in range(end - i + 1)]
    for a in range(end, i - 1, -1):
        for b in range(old_end, j - 1, -1):
            if (a, b) == (end, old_end):
                continue
            ways = [(cost[a + t - i][b + o - j], k, (name, t, o)) for k, (name, t, o) in enumerate(_fits(s, a, b, end, old_end) if a < end and b < old_end else ())]
            if a < end:
                ways.append((cost[a + 1 - i][b - j] + 1, 98, ("none", 1, 0)))
            if b < old_end:
                ways.append((cost[a - i][b + 1 - j] + 1, 99, ("old", 0, 1)))
            cost[a - i][b - j], _, pick[a - i][b - j] = min(ways)
    a, b = i, j
    while (a, b) != (end, old_end):
        name, takes, old = pick[a - i][b - j]
        for k in range(takes):
            out[a + k] = None if name == "none" else (b + (k if name == "pairs" else 0), name)
        a, b = a + takes, b + old


class _Rows:
    """Costs of _fewest_left_out by rows: those of all old places for one new place, from the last new place on. A row follows from the three after it."""

    def __init__(self, s: Sides, end: int, j: int, old_end: int) -> None:
        self.s, self.end, self.j, self.old_end, self.ids = s, end, j, old_end, {None: -1}
        places, known = range(j, old_end), self.ids
        number = lambda made: np.array([known.setdefault(x, len(known)) for x in made], np.int32)
        self.one, self.start = number(s.of[b] for b in places), number(s.of[b][:3] for b in places)
        self.two, self.before = number(_spell(s.of[b], s.of[b + 1]) for b in places), number(s.of[b - 1] + s.of[b] if b > 0 and b + 1 < s.n_old else None for b in places)
        self.fused_h = number(s.of[b] + s.of[b + 1][1:] if len(s.of[b + 1] or "") > 1 else None for b in places)
        self.suffix, self.is_in = np.array([s.ot[b + 1] == SUFFIX for b in places], bool), np.array([s.ot[b] == IN for b in places], bool)
        self.at = np.arange(len(places) + 1, dtype=np.int32)

    def fits(self, a: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """How many new and old morphemes are taken, and the old places at which a rule that takes so many fits at new a: RULES for a whole row."""
        s = self.s
        number = lambda *forms: self.ids.get(_spell(*forms), -2) if None not in forms else -2
        f, t, last = s.nf, s.nt, s.nf[a - 1] if a > 0 else None
        one, pair, start = number(f[a]), number(f[a], f[a + 1]), self.start == number(f[a][:3])
        same = (self.one == one) | (self.one == number(last, f[a]))
        if f[a][:3] in PARTICLES and t[a + 1] == SUFFIX:
            same |= (self.start == number(*(PARTICLES - {f[a][:3]}))) & self.suffix
        if f[a] in WITH_HER and t[a] == SUFFIX:
            same |= self.one == number(*(WITH_HER - {f[a]}))
        yield 1, 1, same
        yield 1, 2, (self.two == one) | (self.fused_h == one) | (self.suffix & start)
        yield 1, 0, (self.one == pair) | ((self.before == number(last, f[a + 1])) & (f[a] == "H"))
        if t[a + 1] == SUFFIX:
            yield 2, 1, np.ones_like(start) if t[a] == IN else start
        b_suffix = f[a] == "B" and t[a] == PREPOSITION and f[a + 1] is not None
        yield 2, 2, (self.two == pair) | (self.is_in & self.suffix) if b_suffix else self.two == pair
        yield 3, 1, np.ones_like(start) if t[a + 1] == IN and t[a + 2] == SUFFIX else (self.one == number(*f[a : a + 3])) | (self.one == number(f[a], f[a + 2]))

    def last(self) -> list[np.ndarray]:
        """The rows at the end and (unreachable) after it."""
        return [self.at[::-1].copy(), *[np.full(len(self.at), 2**30, np.int32)] * 2]

    def row(self, a: int, after: list[np.ndarray]) -> np.ndarray:
        """The costs at new a, from the rows of the next three."""
        cost = after[0] + 1
        for takes, old, here in self.fits(a):
            if a + takes <= self.end:
                b = np.flatnonzero(here[: len(here) + 1 - old] if old else here)
                cost[b] = np.minimum(cost[b], after[takes - 1][b + old])
        # old morphemes may be left out before any of these
        return np.minimum.accumulate((cost + self.at)[::-1])[::-1] - self.at

    def walk(self, low: int, high: int, after: list[np.ndarray], at: tuple[int, int], out: list) -> tuple[int, int]:
        """Go on from at (new, old) to new place high or beyond, given the rows at high and after. Halves are walked one after the other, so few rows are held."""
        if (high - low) * len(self.at) > HELD and high - low > 8:
            middle, rows = (low + high) // 2, after
            for a in range(high - 1, middle - 1, -1):
                rows = [self.row(a, rows), *rows[:2]]
            return self.walk(middle, high, after, self.walk(low, middle, rows, at, out), out)
        cost = dict(zip(range(high, high + 3), after, strict=True))
        for a in range(high - 1, low - 1, -1):
            cost[a] = self.row(a, [cost[a + 1], cost[a + 2], cost[a + 3]])
        a, b = at
        while a < high and (a, b) != (self.end, self.old_end):
            ways = [(cost[a + t][b + o - self.j], k, (name, t, o)) for k, (name, t, o) in enumerate(_fits(self.s, a, b, self.end, self.old_end) if b < self.old_end else ())]
            ways.append((cost[a + 1][b - self.j] + 1, 98, ("none", 1, 0)))
            if b < self.old_end:
                ways.append((cost[a][b + 1 - self.j] + 1, 99, ("old", 0, 1)))
            name, takes, old = min(ways)[2]
            for k in range(takes):
                out[a + k] = None if name == "none" else (b + (k if name == "pairs" else 0), name)
            a, b = a + takes, b + old
        return a, b


def _fewest_left_out_by_rows(s: Sides, i: int, end: int, j: int, old_end: int, out: list) -> None:
    """_fewest_left_out where there are many pairs of places."""
    rows = _Rows(s, end, j, old_end)
    rows.walk(i, end, rows.last(), (i, j), out)  # old morphemes that are left then are left out


def _anchors(s: Sides) -> list[tuple[int, int]]:
    """Places (new, old) of forms that each side has once, in the longest order that both sides share."""
    old_forms, new_forms = s.of[: s.n_old], s.nf[: s.n_new]
    in_old, in_new = Counter(old_forms), Counter(new_forms)
    old = {f: j for j, f in enumerate(old_forms) if in_old[f] == 1}
    pairs = [(i, old[f]) for i, f in enumerate(new_forms) if in_new[f] == 1 and f in old]
    last: list[int] = []  # the least old place that ends an order of each length
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(last, j)
        last[n:], at[n:] = [j, *last[n + 1 :]], [k, *at[n + 1 :]]
        before.append(at[n - 1] if n else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def matched(old: list[tuple[str, str]], new: list[tuple[str, str]]) -> list[tuple[int, str] | None]:
    """For each new (form, tag) the place of the old morpheme whose id it takes, and the rule; None where there is none."""
    s, out = Sides(old, new), [None] * len(new)
    if _from_left(s, 0, s.n_new, 0, s.n_old, out):
        return out
    i = j = 0
    for a, b in [*_anchors(s), (s.n_new, s.n_old)]:
        if (a - i + 1) * (b - j + 1) <= CELLS:
            _fewest_left_out(s, i, a, j, b, out)
        else:
            _fewest_left_out_by_rows(s, i, a, j, b, out)
        if a < s.n_new:
            out[a] = b, "equal"
        i, j = a + 1, b + 1
    return out


def _pairs(column: pa.ListArray) -> Iterator[list[tuple[str, str]]]:
    """The (form, tag) of each row's array."""
    flat = column.flatten()
    both = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    for i, j in zip([0, *ends[:-1]], ends, strict=True):
        yield both[i:j]


def realign_tokens(old: DataFrame, new: DataFrame, sent: list[str]) -> DataFrame:
    """new (sent, pos, form, and cpos if there are tags) with tok_id of old (sent, pos, form, tok_id, cpos) and rule (J22): the first of RULES that fits, or none, with a null id.

    Morphemes follow pos. Sentences without old morphemes get no ids; null forms and tags count as empty."""
    def rows(df: DataFrame, *more: str) -> Column:
        tag = F.coalesce("cpos", F.lit("")) if "cpos" in df.columns else F.lit("")
        return F.array_sort(F.collect_list(F.struct("pos", F.coalesce("form", F.lit("")).alias("form"), tag.alias("tag"), *more)))

    both = new.groupBy(*sent).agg(rows(new).alias("n")).join(old.groupBy(*sent).agg(rows(old, "tok_id").alias("o")), sent, "left")
    each = matched_rows(both, sent).select(*sent, "o", F.explode(F.arrays_zip("n", "hits")).alias("z"))
    return each.select(*sent, F.col("z.n.pos").alias("pos"), F.col("z.n.form").alias("form"), F.expr("o[z.hits.at].tok_id").alias("tok_id"), F.col("z.hits.rule").alias("rule"))


def matched_rows(both: DataFrame, sent: list[str]) -> DataFrame:
    """Rows of a sentence each, with its new and old morphemes in order in the arrays n and o (null: none) of structs with form and tag -> sent, n, o, hits: for each new one the place in o and the rule. No shuffle."""
    both = both.select(*sent, F.expr("transform(n, x -> struct(x.form, x.tag))").alias("nf"), F.expr("coalesce(transform(o, x -> struct(x.form, x.tag)), array())").alias("of"), "n", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [m or (None, "none") for o, n in zip(_pairs(batch["of"]), _pairs(batch["nf"]), strict=True) for m in matched(o, n)]
            flat = pa.StructArray.from_arrays([pa.array([m[0] for m in hit], pa.int32()), pa.array([m[1] for m in hit], pa.string())], names=["at", "rule"])
            lengths = batch["nf"].value_lengths().to_numpy(zero_copy_only=False)
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), hits], names=[*names, "hits"])

    names = [*sent, "n", "o"]
    schema = both.select(*names).withColumn("hits", F.expr("cast(array() as array<struct<at: int, rule: string>>)")).schema
    return both.mapInArrow(run, schema)


def realign_report(old: DataFrame, realigned: DataFrame, sent: list[str]) -> DataFrame:
    """kind, n: sentences of realign_tokens that are the same on both sides (proper), have an id for every new form (match), or not (nomatch)."""
    lengths = old.groupBy(*sent).agg(F.count("*").alias("n_old"))
    per = realigned.groupBy(*sent).agg(F.count("*").alias("n_new"), F.bool_and(F.col("rule") == "equal").alias("same"), F.bool_or(F.col("rule") == "none").alias("lost")).join(lengths, sent, "left")
    return _kinds(per)


def realign_report_rows(matched: DataFrame) -> DataFrame:
    """realign_report of rows of matched_rows. Sentences without new morphemes have no kind."""
    rule = lambda test: test("hits", lambda h: h["rule"] == ("equal" if test is F.forall else "none"))
    per = matched.filter("size(n) > 0").select(F.size("n").alias("n_new"), F.coalesce(F.size("o"), F.lit(0)).alias("n_old"), rule(F.forall).alias("same"), rule(F.exists).alias("lost"))
    return _kinds(per)


def _kinds(per: DataFrame) -> DataFrame:
    kind = F.when(F.col("lost"), F.lit("nomatch")).when(F.col("same") & (F.col("n_new") == F.col("n_old")), F.lit("proper")).otherwise(F.lit("match"))
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
