import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexloom.llm import conversation_repair, queries

SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """(role, text) in order -> for each its first fault or None."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit, turns) by trying every edit at every place: all ways, kept by roles so far."""
    ways = {"": (0, "", ())}

    def better(into, key, way):
        if key not in into or way[:2] < into[key][:2]:
            into[key] = way

    def shape(initials):  # all that the rest depends on
        return initials[-1:] if re.fullmatch("s?(ua)*u?", initials) else None

    def inserted(ways):
        for _ in range(3):
            for key, (cost, audit, turns) in list(ways.items()):
                for role in ("user", "assistant"):
                    got = "".join(r[0] for r, _ in turns) + role[0]
                    if shape(got) is not None:
                        better(ways, shape(got), (cost + 3, audit + "I", (*turns, (role, ""))))
        return ways

    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for cost, audit, turns in inserted(ways).values():
            better(new, shape("".join(r[0] for r, _ in turns)), (cost + 4, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            for edit, price, as_role in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                got = "".join(r[0] for r, _ in turns) + as_role[:1]
                if as_role and shape(got) is not None:
                    better(new, shape(got), (cost + price + more, audit + edit, (*turns, (as_role, text))))
        ways = new
    done = [w for w in inserted(ways).values() if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in w[2]))]
    return min(done, key=lambda w: w[:2])


def brute(rows):
    """The contract on rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, _, _ in kept if t is not None}
        said = [(r, t) for _, r, t in kept]
        faults = faults_of(said)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        cost, audit, repaired = cheapest(said, faults)
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_cheapest_edits_equal_all_ways():
    rng = random.Random(4)
    names, means = ["system", "user", "assistant", "tool"], {"blank": 1, "duplicate": 1, "truncated": 2, None: 0}
    for n in [*range(7)] * 60 + [40, 41, 64, 65]:
        roles = [rng.choice(names) for _ in range(n)]
        faults = [rng.choice([None, None, "blank", "truncated", "duplicate"]) for _ in range(n)]
        codes = bytes(3 * names.index(r) + means[f] for r, f in zip(roles, faults, strict=True))
        assert conversation_repair._cheapest(codes) == cheapest([(r, "") for r in roles], faults)[:2], (roles, faults)


def test_edits_are_least_of_all_strings():
    """Every string of edits of up to seven letters, for conversations of three rows."""
    for roles in itertools.product("suat", repeat=3):
        best = None
        for n in range(3, 8):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != 3 or audit.count("I") > 4:
                    continue
                row, cost, state = iter(roles), 0, ""
                for e in audit:
                    due = "a" if state[-1:] == "u" else "u"
                    if e == "D":
                        next(row)
                        cost += 4
                    elif e == "K":
                        state += next(row)
                    else:
                        state, cost = state + due, cost + 3
                        if e == "R":
                            next(row)
                if re.fullmatch("(s?(ua)+)?", state) and (best is None or (cost, "".join(audit)) < best):
                    best = cost, "".join(audit)
        codes = bytes(3 * "suat".index(r) for r in roles)
        assert conversation_repair._cheapest(codes) == best


def test_the_query_equals_brute_force(spark, sf):
    for where in (sf, sf.replace("0.001", "0.01")):
        rows = spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        assert got(queries.QUERIES["op13_conversation_repair"](spark, where)) == brute([tuple(r) for r in rows])


def test_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, None, None, None), (1, 3, "", "x."), (1, 4, "tool", "y"), (None, 1, "user", "q?"), (None, None, "user", "q?"), (2, None, "system", "s."), (3, 5, "assistant", "\t\n"), (3, 9, "user", "z! \n")]
    rows += [(conv, turn, "user" if turn % 2 else "assistant", f"{turn}.") for conv in range(20, 60) for turn in range(1, 4)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, row int")
    assert got(conversation_repair.report(conversation_repair.damage(df))) == brute(rows)


def test_repeated_rows_and_many_turns(spark):
    rng = random.Random(1)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), f"{i} {rng.choice('.x')}") for i in range(0, 3000, 2)] + [(8, 0, "user", "a.")] * 5
    assert got(conversation_repair.report(conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))) == brute(rows)


def test_nothing_left_and_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert got(conversation_repair.report(conversation_repair.damage(df))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversation_repair.report(conversation_repair.damage(df.filter("false"))).collect() == []


@pytest.mark.parametrize("copies", [1, 2])
def test_repaired_turns(spark, copies):
    rows = [(1, 1, "assistant", "a."), (1, 2, "assistant", "b."), (1, 3, "user", "c"), (2, 1, "user", "")]
    df = spark.createDataFrame([(*r, copies) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    out = sorted(map(tuple, conversation_repair.repair(df).collect()))
    said = [(r, t) for _, _, r, t in rows[:3] for _ in range(copies)]
    _, audit, want = cheapest(said, faults_of(said))
    assert out == [(1, i + 1, e, r, t) for i, (e, (r, t)) in enumerate(zip(audit.replace("D", ""), want, strict=True))]
