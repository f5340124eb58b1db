"""Dependency trees as tables: one row (sent..., id, head, deprel, cpos, ...) for each token; head 0 is the root."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distance_bucket, format_feats, host_feats, suffix_feats, word_key
from .features import compile_templates


def heads(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """arcs with head_of_head (null above the root)."""
    up = arcs.select(*sent, F.col("id").alias("head"), F.col("head").alias("head_of_head"))
    return arcs.join(up, [*sent, "head"], "left")


def modifiers(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """sent, id, modifier, side (l, r), and its place among the modifiers of that side, counted from the farthest left for l and from the farthest right for r."""
    rows = arcs.filter("head > 0").select(*sent, F.col("head").alias("id"), F.col("id").alias("modifier")).withColumn("side", F.when(F.col("modifier") < F.col("id"), F.lit("l")).otherwise(F.lit("r")))
    by = Window.partitionBy(*sent, "id", "side")
    return rows.withColumn("place", F.row_number().over(by.orderBy(F.when(F.col("side") == "l", F.col("modifier")).otherwise(-F.col("modifier")))))


def children(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """One row for each child of a token, with its tag and relation."""
    return arcs.filter("head > 0").select(*sent, F.col("head").alias("id"), F.col("id").alias("child"), F.col("cpos").alias("child_cpos"), F.col("deprel").alias("child_deprel"))


def label_sets(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """By head: left_labels and right_labels (sets), all_labels and all_tags (multisets), sorted and joined by commas."""
    rows = arcs.filter("head > 0")
    join = lambda a: F.array_join(F.array_sort(a), ",")
    side = lambda cond: join(F.collect_set(F.when(cond, F.col("deprel"))))
    return rows.groupBy(*sent, F.col("head").alias("id")).agg(side(F.col("id") < F.col("head")).alias("left_labels"), side(F.col("id") > F.col("head")).alias("right_labels"), join(F.collect_list("deprel")).alias("all_labels"), join(F.collect_list("cpos")).alias("all_tags"))


def valency(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """By head: left, right and all modifiers."""
    return arcs.filter("head > 0").groupBy(*sent, F.col("head").alias("id")).agg(F.count_if(F.col("id") < F.col("head")).alias("n_left"), F.count_if(F.col("id") > F.col("head")).alias("n_right"), F.count("*").alias("n_all"))


def query_arcs(arcs: DataFrame, head: int | None = None, modifier: int | None = None, deprel: str | None = None) -> DataFrame:
    """Arcs that match the parts given."""
    for name, value in (("head", head), ("id", modifier), ("deprel", deprel)):
        if value is not None:
            arcs = arcs.filter(F.col(name) == value)
    return arcs


def _more_in_a(a: DataFrame, b: DataFrame, sent: list[str]) -> DataFrame:
    """sent, id, head, deprel, n: how many more of an arc a has than b. Both sides go through one shuffle, by sentence."""
    arc = [*sent, "id", "head", "deprel"]
    both = a.select(*arc, F.lit(1).alias("_n")).unionByName(b.select(*arc, F.lit(-1).alias("_n")))
    return both.repartition(*sent).groupBy(*arc).agg(F.sum("_n").alias("n"))


def diff_arcs(a: DataFrame, b: DataFrame, sent: list[str]) -> DataFrame:
    """Arcs of one side only, with side a or b; repeats count."""
    more = _more_in_a(a, b, sent).filter("n <> 0")
    side = F.array_repeat(F.when(F.col("n") > 0, F.lit("a")).otherwise(F.lit("b")), F.abs("n").cast("int"))
    return more.select(*sent, "id", "head", "deprel", F.explode(side).alias("side"))


def same_arcs(a: DataFrame, b: DataFrame, sent: list[str]) -> DataFrame:
    """sent, same: whether both sides have the same arcs (T4)."""
    return _more_in_a(a, b, sent).groupBy(*sent).agg(F.bool_and(F.col("n") == 0).alias("same"))


def attach_orphans(arcs: DataFrame, sent: list[str], root_label: str = "ROOT") -> DataFrame:
    """Tokens without a head get one: the first token with root_label (relation punct), or are the root themselves where there is none (the first of them).

    A token with root_label hangs from 0, whatever its head was."""
    by = Window.partitionBy(*sent)
    labelled = F.col("head").isNotNull() & (F.col("deprel") == root_label)
    root = F.coalesce(F.min(F.when(labelled, F.col("id"))).over(by), F.min(F.when(F.col("head").isNull(), F.col("id"))).over(by))
    orphan = F.col("head").isNull()
    rows = arcs.withColumn("_root", root)
    rows = rows.withColumn("deprel", F.when(orphan & (F.col("id") == F.col("_root")), F.lit("root")).when(orphan, F.lit("punct")).otherwise(F.col("deprel")))
    return rows.withColumn("head", F.when((orphan & (F.col("id") == F.col("_root"))) | labelled, F.lit(0)).when(orphan, F.col("_root")).otherwise(F.col("head"))).drop("_root")


def merge_tokens(arcs: DataFrame, mapping: DataFrame, sent: list[str]) -> DataFrame:
    """arcs (id: morpheme ordinal) with the token of each morpheme; mapping: sent, tok_no, morph_idx, form."""
    order = Window.partitionBy(*sent).orderBy("tok_no", "morph_idx")
    placed = mapping.withColumn("id", F.row_number().over(order)).select(*sent, "id", "tok_no", F.col("form").alias("morph"))
    return arcs.join(placed, [*sent, "id"], "left")


def training_record(arcs: DataFrame, gold: DataFrame, candidates: DataFrame, sent: list[str]) -> DataFrame:
    """One nested row a sentence (J15): tree (array of id, head, deprel), gold (array of tok_no, morphs), lattice (array of tok_no, paths: an array of morphs), and
    complete, whether all three are there; sentences that lack one keep nulls in its place, for the caller to set aside."""
    tree = arcs.groupBy(*sent).agg(F.array_sort(F.collect_list(F.struct("id", "head", "deprel"))).alias("tree"))
    paths = gold.groupBy(*sent).agg(F.array_sort(F.collect_list(F.struct("tok_no", "morphs"))).alias("gold"))
    tokens = candidates.groupBy(*sent, "tok_no").agg(F.array_sort(F.collect_list("morphs")).alias("paths"))
    lattice = tokens.groupBy(*sent).agg(F.array_sort(F.collect_list(F.struct("tok_no", "paths"))).alias("lattice"))
    whole = F.col("tree").isNotNull() & F.col("gold").isNotNull() & F.col("lattice").isNotNull()
    return tree.join(paths, sent, "full_outer").join(lattice, sent, "full_outer").withColumn("complete", whole)


RELATIVES = ("h", "h2", "l", "l2", "r", "r2")


def address(arcs: DataFrame, sent: list[str], values: dict[str, Column], relatives: tuple[str, ...] = RELATIVES) -> DataFrame:
    """For each token the attributes of itself and of its relatives: h, h2, l, l2, r, r2.

    values: attribute name -> column of arcs. Columns come out as self_<name>, h_<name>, ..., and a relative's id as h, ... One shuffle, by sentence."""
    one = arcs.groupBy(*sent).agg(F.collect_list(F.struct("id", "head", F.struct(*(v.alias(k) for k, v in values.items())).alias("v"))).alias("_t"))
    return address_within(one, sent, "_t", {k: lambda t, k=k: t["v"][k] for k in values}, relatives)


def address_within(rows: DataFrame, sent: list[str], array: str, values: dict[str, Callable[[Column], Column]], relatives: tuple[str, ...] = RELATIVES) -> DataFrame:
    """address of rows that are one sentence each, with its tokens (id, head) in an array; values are made of an element. No shuffle.

    Where ids follow each other without gaps, tokens are found by their place, and modifiers behind their head in one sorted array: n log n for n tokens. In other
    sentences each look-up reads the sentence, and a relative's id that several tokens have gives a row for each of them, as a join would."""
    t = F.array_sort(F.transform(array, lambda a: F.struct(a["id"].alias("id"), a["head"].alias("head"), F.struct(*(f(a).alias(k) for k, f in values.items())).alias("v"))))
    one = rows.select(*sent, t.alias("_t")).filter("size(_t) > 0")
    # each id, then the ids of what hangs on it; _p: the places of the ids themselves
    hung = F.transform(F.filter("_t", lambda a: a["head"] > 0), lambda a: F.struct(a["head"].alias("of"), F.lit(1).alias("hangs"), a["id"].alias("id")))
    one = one.withColumn("_s", F.array_sort(F.concat(F.transform("_t", lambda a: F.struct(a["id"].alias("of"), F.lit(0).alias("hangs"), a["id"].alias("id"))), hung)))
    one = one.withColumn("_p", F.expr("transform(filter(transform(_s, (x, i) -> struct(x.hangs as hangs, i as i)), x -> x.hangs = 0), x -> x.i)"))
    one = one.withColumn("_dense", F.expr("coalesce(_t[size(_t) - 1].id - _t[0].id = size(_t) - 1 and size(array_distinct(transform(_t, x -> x.id))) = size(_t), false)"))

    def made(a: Column, found: dict[str, tuple[Column, Column]]) -> Column:
        shown = lambda prefix, x: (x["v"][k].alias(f"{prefix}_{k}") for k in values)
        return F.struct(a["id"].alias("id"), a["head"].alias("head"), *shown("self", a), *(c for n in relatives for c in (found[n][0].alias(n), *shown(n, found[n][1]))))

    def by_place(a: Column, k: Column) -> Column:
        token = lambda v: F.get("_t", v - F.col("_t")[0]["id"])
        place, end = F.get("_p", k), F.coalesce(F.get("_p", k + 1), F.size("_s"))

        def hangs(i: Column, left: bool) -> Column:
            x = F.get("_s", i)
            side = x["id"] < a["id"] if left else x["id"] >= a["id"]
            return F.when((i > place) & (i < end) & (x["of"] == a["id"]) & side, x["id"])

        ids = {"h": a["head"], "h2": token(a["head"])["head"], "l": hangs(place + 1, True), "l2": hangs(place + 2, True), "r": hangs(end - 1, False), "r2": hangs(end - 2, False)}
        return made(a, {n: (ids[n], token(ids[n])) for n in relatives})

    def by_search(a: Column) -> Column:
        none = F.slice(F.col("_t"), 1, 0)
        having = lambda v: F.filter("_t", lambda x: x["id"] == v)
        ids = F.array_sort(F.transform(F.filter("_t", lambda x: (x["head"] > 0) & (x["head"] == a["id"])), lambda x: x["id"]))
        left, right = F.filter(ids, lambda x: x < a["id"]), F.filter(ids, lambda x: x >= a["id"])
        keys = {"l": F.get(left, F.lit(0)), "l2": F.get(left, F.lit(1)), "r": F.get(right, F.size(right) - 1), "r2": F.get(right, F.size(right) - 2)}

        def on(names: list[str], found: dict[str, tuple[Column, Column]], up: Column | None) -> Column:
            if not names:
                return F.array(made(a, found))
            n, key = names[0], {"h": a["head"], "h2": up["head"] if up is not None else None, **keys}[names[0]]
            hits = having(key)
            hits = F.when(F.size(hits) > 0, hits).otherwise(F.array_append(none, F.get("_t", F.lit(-1))))
            return F.flatten(F.transform(hits, lambda x: on(names[1:], {**found, n: (key, x)}, x if n == "h" else up)))

        order = [n for n in RELATIVES if n in relatives or (n == "h" and "h2" in relatives)]
        return on(order, {}, None)

    out = F.when(F.col("_dense"), F.transform("_t", by_place)).otherwise(F.flatten(F.transform("_t", by_search)))
    return one.select(*sent, F.inline(out))


def has_arcs(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """sent, id, has_head (an arc leads to it, also one from the root), has_modifiers."""
    used = arcs.filter("head > 0").select(*sent, F.col("head").alias("id")).distinct().withColumn("has_modifiers", F.lit(True))
    return arcs.select(*sent, "id", F.col("head").isNotNull().alias("has_head")).join(used, [*sent, "id"], "left").withColumn("has_modifiers", F.coalesce("has_modifiers", F.lit(False)))


def to_conll(arcs: DataFrame, sent: list[str], root_label: str = "ROOT", within: str | None = None) -> DataFrame:
    """Trees of morphemes (id, form, lemma, cpos, pos, feat_str, head, deprel) -> rows for sinks.conll_lines: an absent arc has head 0 and relation None, one with root_label head 0.

    within: rows are sentences with their morphemes in this array, here and in the result."""

    def made(c: Callable[[str], Column]) -> list[Column]:
        absent = c("head").isNull()
        head = F.when(absent | (c("deprel") == root_label), F.lit(0)).otherwise(c("head"))
        return [*(c(n).alias(n) for n in ("id", "form", "lemma", "cpos", "pos", "feat_str")), head.alias("head"), F.when(absent, F.lit("None")).otherwise(c("deprel")).alias("deprel")]

    if within is None:
        return arcs.select(*sent, *made(F.col))
    return arcs.select(*sent, F.transform(within, lambda r: F.struct(*made(lambda c: r[c]))).alias(within))


def to_conllu(arcs: DataFrame, sent: list[str], root_label: str = "ROOT") -> DataFrame:
    """As to_conll, with tok_no and token, for sinks.conllu_lines: tokens without an arc hang from the root."""
    return attach_orphans(arcs, sent, root_label).select(*sent, "id", "tok_no", "token", "form", "lemma", F.col("cpos").alias("upos"), F.col("pos").alias("xpos"), "feat_str", "head", "deprel")


def from_conll(rows: DataFrame, sent: list[str], kind: str = "form", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of read_conll (sent: path, block or others) -> tree rows with word (by kind as in word_key), word_pos, host and suffix features, and the columns in more."""
    word = word_key("form", "lemma", kind)
    return rows.select(*sent, "id", "form", "lemma", "cpos", "pos", "feat_str", "head", "deprel", word.alias("word"), F.concat_ws("~", word, "cpos").alias("word_pos"), format_feats(host_feats("feats")).alias("host"), format_feats(suffix_feats("feats")).alias("suffix"), *more)


def from_conllu(rows: DataFrame, sent: list[str], kind: str = "form") -> DataFrame:
    """Rows of read_conllu -> tree rows with tok_no and token; the universal tag is the tag."""
    return from_conll(rows.withColumnsRenamed({"upos": "cpos", "xpos": "pos"}), sent, kind, ("tok_no", "token"))


def to_lattice(morphs: DataFrame, sent: list[str]) -> DataFrame:
    """Morphemes of a sentence in a row (id from 1, tok_no) -> the lattice that has this one path, from id - 1 to id, for sinks.lattice_lines; an empty feat_str is _."""
    return morphs.select(*sent, "tok_no", "token", (F.col("id") - 1).alias("from_node"), F.col("id").alias("to_node"), "form", "lemma", "cpos", "pos", F.coalesce(F.nullif("feat_str", F.lit("")), F.lit("_")).alias("feat_str"))


def to_tagged(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """sent, tagged: an array of (form, cpos) in order."""
    made = F.array_sort(F.collect_list(F.struct("id", "form", "cpos")))
    return arcs.groupBy(*sent).agg(F.transform(made, lambda r: F.struct(r["form"].alias("form"), r["cpos"].alias("cpos"))).alias("tagged"))


def _token_attributes(arcs: DataFrame, sent: list[str]) -> DataFrame:
    """arcs (id, head, deprel, form, cpos, host, suffix) with all attributes of F3 that a finished tree has, as strings, and the places of l, l2, r, r2.

    Each arc goes to its own place and to that of its head; places are put together where the sentence's rows are."""
    own, modifier = F.struct("head", "deprel", "form", "cpos", "host", "suffix"), F.struct("id", "deprel", "cpos")
    both = F.array(F.struct(F.col("id").alias("at"), own.alias("own"), F.lit(None).alias("m")), F.struct(F.when(F.col("head") > 0, F.col("head")).alias("at"), F.lit(None).alias("own"), modifier.alias("m")))
    places = arcs.select(*sent, F.inline(both)).filter("own is not null or at is not null").groupBy(*sent, F.col("at").alias("id")).agg(F.collect_list("own").alias("own"), F.array_sort(F.collect_list("m")).alias("m"))
    rows = places.select(*sent, "id", "m", F.inline("own")).withColumns({"_l": F.filter("m", lambda x: x["id"] < F.col("id")), "_r": F.filter("m", lambda x: ~(x["id"] < F.col("id")))})
    of = lambda c, a: F.array_sort(F.transform(a, lambda x: x[c]))
    joined = lambda a: F.array_join(a, ",")
    rows = rows.withColumns({"left_labels": joined(F.array_distinct(of("deprel", "_l"))), "right_labels": joined(F.array_distinct(of("deprel", F.filter("m", lambda x: x["id"] > F.col("id"))))), "all_labels": joined(of("deprel", "m")), "all_tags": joined(of("cpos", "m"))})
    rows = rows.withColumns({c: F.transform(c, lambda x: x["id"]) for c in ("_l", "_r")})
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    at = lambda c, i: F.get(c, F.lit(i)) if i >= 0 else F.get(c, F.size(c) + i)
    text = lambda c: F.coalesce(c, F.lit(""))
    sides = [n("_l"), n("_r")]
    return rows.select(
        *sent, "id", "head", F.col("form").alias("w"), F.concat_ws("~", "form", "cpos").alias("wp"), F.col("cpos").alias("p"), F.when(F.col("head").isNotNull(), F.col("deprel")).alias("l"),
        sides[0].cast("string").alias("vl"), sides[1].cast("string").alias("vr"), (sides[0] + sides[1]).cast("string").alias("vf"),
        text("left_labels").alias("sl"), text("right_labels").alias("sr"), text("all_labels").alias("sf"), text("all_tags").alias("fp"), F.col("host").alias("h"), F.col("suffix").alias("x"),
        at("_l", 0).alias("at_l"), at("_l", 1).alias("at_l2"), at("_r", -1).alias("at_r"), at("_r", -2).alias("at_r2"),
    )


def arc_features(arcs: DataFrame, sent: list[str], templates: list[str], together: bool = False) -> DataFrame:
    """Arcs between two tokens of finished trees -> sent, id, head, features: an array of name=value for each template that has a value.

    arcs: id (1 to n in a sentence), head, deprel, form, cpos, host, suffix. Addresses: S0 and N0 are the left and the right end of the arc,
    N1, N2, ... the tokens after N0, and h, h2, l, l2, r, r2 after them their relatives. Attributes: w, wp, p, l (relation), d (distance of S0 and N0 by
    distance_bucket), vl, vr, vf (numbers of modifiers), sl, sr, sf (their relations), fp (their tags), h, x (host and suffix features). What hangs on a
    parser's state (S1 and beyond, the heads on its stack) has no value in a finished tree and is an error.
    A feature is missing where a requirement is; other missing values are empty. Sentences without such arcs, and null heads, give no row.

    One row holds a sentence, and its arcs look their tokens up there: the work is linear in its length, and the tree is joined with itself nowhere.
    One shuffle, by sentence; none with together, if arcs are made of sentences' rows that are dealt out by sent."""
    toks = _token_attributes(arcs if together else arcs.repartition(*sent), sent)
    given = [c for c in toks.columns if c not in sent]
    one = toks.groupBy(*sent).agg(F.array_sort(F.collect_list(F.struct(*given))).alias("_t"))
    compiled = compile_templates(templates)
    addresses = sorted({a for _, elements, needs in compiled for a, _ in elements + needs})

    def node(arc: Column, address: str) -> Column:
        base, found = re.fullmatch("([A-Z][0-9]+)(.*)", address).groups()
        token = lambda place: F.get("_t", place - 1)
        if base == "S0":
            start = token(F.least(arc["id"], arc["head"]))
        elif base.startswith("N"):
            start = token(F.greatest(arc["id"], arc["head"]) + int(base[1:]))
        else:
            raise ValueError(f"no address {address} in finished trees")
        if not found:
            return start
        if found not in RELATIVES:
            raise ValueError(f"no relative {found}")
        return token(token(start["head"])["head"]) if found == "h2" else token(start["head"] if found == "h" else start[f"at_{found}"])

    def value(address: str, attr: str) -> Column:
        if attr == "d":
            return F.when(F.col(f"a.{address}").isNotNull(), distance_bucket("a.id", "a.head").cast("string"))
        if attr not in given or attr.startswith("at_") or attr in ("id", "head"):
            raise ValueError(f"no attribute {attr} in finished trees")
        return F.col(f"a.{address}.{attr}")

    made = []
    for name, elements, needs in compiled:
        text = F.concat_ws("~", *(F.coalesce(value(a, x), F.lit("")) for a, xs in elements for x in xs))
        there = F.lit(True)
        for a, xs in needs:
            for x in xs:
                there = there & value(a, x).isNotNull()
        made.append(F.when(there, F.concat(F.lit(f"{name}="), text)))
    ends = F.transform(F.filter("_t", lambda t: t["head"] > 0), lambda t: F.struct(t["id"].alias("id"), t["head"].alias("head"), *(node(t, a).alias(a) for a in addresses)))
    return one.select(*sent, F.explode(ends).alias("a")).select(*sent, F.col("a.id").alias("id"), F.col("a.head").alias("head"), F.array_compact(F.array(*made)).alias("features"))
