"""Column builders for forms, tags and feature strings. All are built-in expressions, so they stay in code generation or
JVM-side higher-order functions; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WORD = r"[^\x20\x09-\x0D]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict[str, str | None], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


# B12
def from_underscore(c: str | Column) -> Column:
    """The empty string for _."""
    c = _col(c)
    return F.when(c == "_", F.lit("")).otherwise(c)


def to_underscore(c: str | Column) -> Column:
    """_ for empty and null."""
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.lit("_")).otherwise(c)


def parse_int(c: str | Column) -> Column:
    """0 for _, null for what is no number."""
    c = _col(c)
    return F.when(c == "_", F.lit(0)).otherwise(c.try_cast("int"))


# B1
def feature_pairs(c: str | Column) -> Column:
    """The parts of a feature string; none for _, empty and null."""
    c = F.coalesce(from_underscore(c), F.lit(""))
    return F.filter(F.split(c, r"\|"), lambda p: p != "")


def parse_feats(c: str | Column, mode: str = "conll") -> Column:
    """Feature string -> map; values of a repeated key are joined by commas in order.

    mode conll, conllu: parts without = make the whole map null. mode lattice: a bare k is k=k, and k== has the value =."""
    pairs = feature_pairs(c)
    key = lambda p: F.substring_index(p, "=", 1)
    if mode == "lattice":
        value = lambda p: F.when(F.locate("=", p) == 0, p).otherwise(p.substr(F.locate("=", p) + 1, F.length(p)))
    else:
        value = lambda p: p.substr(F.locate("=", p) + 1, F.length(p))
    keys = F.array_distinct(F.transform(pairs, key))
    values = F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: key(p) == k), value), ","))
    out = F.map_from_arrays(keys, values)
    return out if mode == "lattice" else F.when(~F.exists(pairs, lambda p: F.locate("=", p) == 0), out)


# B2, B3
def format_feats(m: str | Column) -> Column:
    """Map -> sorted k=v joined by |; _ for an empty or null map."""
    m = _col(m)
    return to_underscore(F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|"))


def host_feats(m: str | Column) -> Column:
    """Features whose key does not begin with suf."""
    return F.map_filter(_col(m), lambda k, v: ~F.startswith(k, F.lit("suf")))


def suffix_feats(m: str | Column) -> Column:
    return F.map_filter(_col(m), lambda k, v: F.startswith(k, F.lit("suf")))


# B4, P11
def union_feats(a: str | Column, b: str | Column) -> Column:
    """Both maps; values of a key that both have are joined by a comma."""
    return F.map_zip_with(_col(a), _col(b), lambda k, x, y: F.concat_ws(",", x, y))


def merge_feats(a: str | Column, b: str | Column) -> Column:
    """Both feature strings as one, sorted, without repeats; the empty string if both are empty. A string alone keeps its order."""
    x, y = feature_pairs(a), feature_pairs(b)
    one = F.concat(x, y)
    return F.array_join(F.when((F.size(x) > 0) & (F.size(y) > 0), F.array_sort(F.array_distinct(one))).otherwise(one), "|")


def add_feat(a: str | Column, feature: str | Column) -> Column:
    """The feature after the string, by | unless it is empty."""
    a = F.coalesce(_col(a), F.lit(""))
    return F.when(a == "", _col(feature)).otherwise(F.concat_ws("|", a, _col(feature)))


def drop_feat(a: str | Column, key: str) -> Column:
    """The feature string without the features of key."""
    return F.array_join(F.filter(feature_pairs(a), lambda p: F.substring_index(p, "=", 1) != key), "|")


def strip_feats(feats: str | Column, tag: str | Column, proper: str = "NNP") -> Column:
    """_ for proper nouns, else the feature string."""
    return F.when(_col(tag) == proper, F.lit("_")).otherwise(_col(feats))


# B5, B6
def universal_tag(tag: str | Column, prefix: bool = False) -> Column:
    """Universal tag, with its own features after a -; null for tags that have none."""
    return _lookup(fixed.UNIVERSAL_PREFIX_TAG if prefix else fixed.UNIVERSAL_TAG, _col(tag))


def universal_feats(feats: str | Column) -> Column:
    """Universal features, sorted; _ stays. Features without a universal one are no part of it: unknown_feats names those that the table doesn't know."""
    feats = _col(feats)
    table = {k: v or "" for k, v in fixed.UNIVERSAL_FEATURE.items()}
    made = F.filter(F.transform(F.split(feats, r"\|"), lambda p: _lookup(table, p)), lambda p: p.isNotNull() & (p != ""))
    return F.when(feats == "_", feats).otherwise(F.array_join(F.array_sort(F.flatten(F.transform(made, lambda p: F.split(p, r"\|")))), "|"))


def unknown_feats(feats: str | Column) -> Column:
    """Array of the features, in their order, that the table of universal features doesn't know; a caller stops or sets the row aside where it is not empty."""
    pairs = F.filter(F.split(_col(feats), r"\|"), lambda p: ~p.isin("", "_"))
    return F.filter(pairs, lambda p: ~p.isin(*fixed.UNIVERSAL_FEATURE))


# B7, B8
def parse_msr(msr: str | Column, suffix: bool = False, skip: tuple[str, ...] = ("binyan", "type", "polar")) -> Column:
    """Lexicon code tag-code-code -> struct(tag, feat_str): known codes' features sorted, without the families in skip."""
    parts = F.split(_col(msr), "-")
    table = {k: ("|".join("suf_" + p for p in v.split("|")) if suffix else v) for k, v in fixed.MSR_FEATURE.items() if v.split("=")[0] not in skip}
    known = F.filter(F.transform(F.array_sort(F.slice(parts, 2, 64)), lambda p: _lookup(table, p)), lambda p: p.isNotNull())
    return F.struct(parts[0].alias("tag"), F.array_join(F.array_sort(known), "|").alias("feat_str"))


def parse_msr_suffix(host_tag: str | Column, msr: str | Column) -> Column:
    """Code of a pronominal suffix -> struct(bridge, form, feat_str): the word before the pronoun by the host's tag, the pronoun, its features."""
    codes = F.slice(F.split(_col(msr), "-"), 2, 64)
    bridge = F.coalesce(_lookup(fixed.BRIDGE, _col(host_tag)), F.lit(""))
    pronoun = F.coalesce(_lookup(fixed.PRONOUN, F.array_join(codes, "-")), F.lit(fixed.OTHER_PRONOUN))
    return F.struct(bridge.alias("bridge"), pronoun.alias("form"), parse_msr(msr, skip=("binyan", "type"))["feat_str"].alias("feat_str"))


# B9
CLASSES = (r"\p{Nd}", r"[\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}]", r"\p{L}", r"\p{Ll}", r"\p{M}", r"\p{N}", r"\p{P}", r"\p{S}", r"\p{Lt}", r"\p{Lu}")


def signature(c: str | Column) -> Column:
    """t or f for each of ten character classes that some character of the form is in."""
    return F.concat(*(F.when(F.rlike(_col(c), F.lit(k)), F.lit("t")).otherwise(F.lit("f")) for k in CLASSES))


# B10
def prefixes(c: str | Column, n: int) -> Column:
    """The first 1 to n characters; the whole form where it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(_col(c), F.lit(1), i))


def suffixes(c: str | Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.right(_col(c), i))


# B11
def to_latin(c: str | Column) -> Column:
    """Transliteration; punctuation gets its name, characters without a letter go."""
    c = _col(c)
    letters = F.regexp_replace(c, f"[^{fixed.LETTERS}{fixed.FINAL_LETTERS}]", "")
    return F.coalesce(_lookup(fixed.PUNCTUATION, c), F.translate(letters, fixed.LETTERS + fixed.FINAL_LETTERS, fixed.LATIN + fixed.FINAL_LATIN))


def from_latin(c: str | Column) -> Column:
    """Back, with a final letter at the end."""
    c = _col(c)
    letters = F.translate(F.regexp_replace(c, f"[^{fixed.LATIN}]", ""), fixed.LATIN, fixed.LETTERS)
    last = F.translate(F.right(letters, F.lit(1)), fixed.BEFORE_FINAL, fixed.AS_FINAL)
    return F.coalesce(_lookup({v: k for k, v in fixed.PUNCTUATION.items()}, c), F.when(letters != "", F.concat(F.substring(letters, F.lit(1), F.length(letters) - 1), last)).otherwise(letters))


# B14
def distance_bucket(a: str | Column, b: str | Column) -> Column:
    """Distance 0 to 5 as it is, 6 to 10 as 5, more as 6."""
    d = F.abs(_col(a) - _col(b))
    return F.when(d > 10, F.lit(6)).when(d > 5, F.lit(5)).otherwise(d).cast("int")


# P4, P5, P6
def regex_tag(c: str | Column) -> Column:
    """CD for a number, NCD for a form with a digit, else null."""
    c = _col(c)
    return F.when(F.rlike(c, F.lit(r"^\d+(\.\d+)?$|^\d{1,3}(,\d{3})*(\.\d+)?$")), F.lit("CD")).when(F.rlike(c, F.lit(r"\d")), F.lit("NCD"))


def punct_tag(c: str | Column, universal: bool = False) -> Column:
    """Name of a punctuation mark (PUNCT in universal mode), else null."""
    name = _lookup(fixed.PUNCTUATION, _col(c))
    return F.when(name.isNotNull(), F.lit("PUNCT")) if universal else name


def is_open_class(tag: str | Column, family: str = "HEBTB") -> Column:
    return _col(tag).isin(*fixed.OPEN_CLASSES[family])


# P7, P8, E1
def _field(m: Column, name: str) -> Column:
    return F.coalesce(m[name], F.lit(""))


def _join(*names: str) -> Callable[[Column, Column], Column]:
    return lambda m, open_class: F.concat_ws("_", *(_field(m, n) for n in names))


def _open(yes: tuple[str, ...], no: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    return lambda m, open_class: F.when(open_class, _join(*yes)(m, open_class)).otherwise(_join(*no)(m, open_class))


def _clitic(m: Column, open_class: Column) -> Column:
    mark = (F.length(m["form"]) > 1) & F.endswith(m["form"], F.lit("_"))
    with_mark = F.when(mark, F.concat(F.lit("s_"), _join("cpos", "feat_str")(m, open_class))).otherwise(_join("cpos", "feat_str")(m, open_class))
    return F.when(open_class, with_mark).otherwise(_join("form", "cpos", "feat_str")(m, open_class))


#: Projection name -> builder of (morpheme struct, whether its tag is open-class).
PROJECTIONS: dict[str, Callable[[Column, Column], Column]] = {
    "Form": _join("form"), "Lemma": _join("lemma"), "Form_Prop": _join("form", "feat_str"), "POS": _join("cpos"), "POS_Prop": _join("cpos", "feat_str"),
    "Form_POS_Prop": _join("form", "cpos", "feat_str"), "Lemma_POS_Prop": _join("lemma", "cpos", "feat_str"), "Form_Lemma_POS_Prop": _join("form", "lemma", "cpos", "feat_str"),
    "Form_POS": _join("form", "cpos"), "Funcs_Main_POS": _open(("cpos",), ("form", "cpos")), "Funcs_Main_POS_Prop": _open(("cpos", "feat_str"), ("form", "cpos", "feat_str")),
    "Funcs_Main_POS_No_Prop": _open(("cpos",), ("form", "cpos", "feat_str")), "Funcs_Main_POS_Both_Prop": _open(("cpos", "feat_str"), ("form", "cpos", "feat_str")),
    "Funcs_Main_POS_Both_Prop_Clitic": _clitic, "Funcs_Main_POS_Both_Prop_WLemma": _join("lemma", "cpos", "feat_str"),
    "Funcs_All_WLemma": _join("form", "lemma", "cpos", "pos", "feat_str"), "Funcs_Lemma_Main_POS": _open(("cpos",), ("lemma", "cpos")),
}


def register_projection(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Make a projection known by name; build gets the morpheme struct and whether its tag is open-class."""
    PROJECTIONS[name] = build


def projection(name: str, morph: str | Column, family: str = "HEBTB") -> Column:
    """The named projection of a morpheme struct (form, lemma, cpos, pos, feat_str)."""
    m = _col(morph)
    return PROJECTIONS[name](m, is_open_class(m["cpos"], family))


def project_path(name: str, morphs: str | Column, family: str = "HEBTB") -> Column:
    """Projections of a path's morphemes, joined by ;"""
    return F.array_join(F.transform(_col(morphs), lambda m: projection(name, m, family)), ";")


# P12
def word_key(form: str | Column, lemma: str | Column, kind: str = "form") -> Column:
    """form, lemma, either (lemma, else form) or none."""
    form, lemma = _col(form), _col(lemma)
    return {"form": form, "lemma": lemma, "either": F.coalesce(F.nullif(lemma, F.lit("")), form), "none": F.lit("")}[kind]


# B13
def morph_string(m: str | Column, lemma: bool = True) -> Column:
    m = _col(m)
    names = ["form", *(["lemma"] if lemma else []), "cpos", "pos", "feat_str"]
    return F.concat_ws(":", m["edge_id"].cast("string"), F.concat_ws("-", m["from_node"].cast("string"), m["to_node"].cast("string")), *(to_underscore(m[n]) for n in names))


def full_string(m: Column) -> Column:
    """form-lemma-cpos-pos-features-(from->to)."""
    nodes = F.concat(F.lit("("), m["from_node"].cast("string"), F.lit("->"), m["to_node"].cast("string"), F.lit(")"))
    return F.concat_ws("-", *(F.coalesce(m[n], F.lit("")) for n in ("form", "lemma", "cpos", "pos", "feat_str")), nodes)


def path_string(morphs: str | Column, sep: str = ";") -> Column:
    """A path's morphemes in full, by which paths are ordered; with sep : as it is shown."""
    return F.array_join(F.transform(_col(morphs), full_string), sep)


def mapping_string(token: str | Column, morphs: str | Column) -> Column:
    """A token with the form, tag and features of its path's last morpheme; the token alone where the path is empty."""
    last = lambda n: F.coalesce(F.try_element_at(_col(morphs), F.lit(-1))[n], F.lit(""))
    return F.when(F.size(_col(morphs)) > 0, F.concat(_col(token), F.lit("|"), F.concat_ws("-", last("form"), last("pos"), last("feat_str")))).otherwise(_col(token))


# B15, B16, B17
def token_of_path(morphs: str | Column, fused: bool = False) -> Column:
    """The morphemes' forms in a row; fused: an inner H (not at the path's ends) is not written."""
    morphs = _col(morphs)
    if fused:
        morphs = F.filter(morphs, lambda m, i: (m["form"] != "H") | (i == 0) | (i == F.size(morphs) - 1))
    return F.array_join(F.transform(morphs, lambda m: m["form"]), "")


def join_sentence(forms: str | Column, sep: str = " ") -> Column:
    return F.array_join(_col(forms), sep)


def count_morphemes(analyses: str | Column) -> Column:
    """Morphemes in all analyses of an entry."""
    return F.aggregate(_col(analyses), F.lit(0), lambda n, a: n + F.size(a))


# B18
def sign(c: str | Column) -> Column:
    return F.signum(_col(c)).cast("int")


def compare(a: str | Column, b: str | Column) -> Column:
    """-1, 0 or 1 by order of strings."""
    return F.when(_col(a) < _col(b), F.lit(-1)).when(_col(a) > _col(b), F.lit(1)).otherwise(F.lit(0))


# B19
def same_morph(a: str | Column, b: str | Column) -> Column:
    """Null-safe equality of two morphemes' forms, tags and features."""
    a, b = _col(a), _col(b)
    return F.lit(True) if a is b else a["form"].eqNullSafe(b["form"]) & a["cpos"].eqNullSafe(b["cpos"]) & a["pos"].eqNullSafe(b["pos"]) & a["feat_str"].eqNullSafe(b["feat_str"])


def same_path(a: str | Column, b: str | Column) -> Column:
    """Whether two arrays of morphemes are equal in order: form, lemma, tags and features; nodes don't count."""
    bare = lambda c: F.transform(_col(c), lambda m: F.struct(*(m[n].alias(n) for n in ("form", "lemma", "cpos", "pos", "feat_str"))))
    return bare(a).eqNullSafe(bare(b))


def same_mapping(token_a: str | Column, a: str | Column, token_b: str | Column, b: str | Column) -> Column:
    """The same token with the same path."""
    return _col(token_a).eqNullSafe(_col(token_b)) & same_path(a, b)


def same_sentence(a: str | Column, b: str | Column) -> Column:
    """Whether two arrays of tokens are equal."""
    return _col(a).eqNullSafe(_col(b))
