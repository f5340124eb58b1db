"""Dictionaries learned from annotated tokens, and the lookup of tokens in them.

A dictionary is a long table (form, lemma, cpos, feat_str) of distinct analyses. Lookups analyse
distinct forms and join back, so a form that holds a large part of all tokens is analysed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import punct_tag, regex_tag
from ..plans.ranking import top_n, top_n_per

#: Fixed value.
PUNCTUATION = ",.|?!:;-&»«\"[]()<>"
ANALYSIS = ["lemma", "cpos", "feat_str"]


def learn_dictionary(tokens: DataFrame) -> DataFrame:
    """Distinct analyses of each form (A1)."""
    return tokens.select("form", *ANALYSIS).distinct()


def _counted(dictionary: DataFrame) -> DataFrame:
    """Analyses that count for tag frequencies: no punctuation tags, no punctuation (but |) in features."""
    inner = "".join("\\" + c for c in PUNCTUATION if c != "|")
    tags = "".join("\\" + c for c in PUNCTUATION)
    return dictionary.filter(~F.rlike("cpos", F.lit(f"^[{tags}]$")) & ~F.rlike("feat_str", F.lit(f"[{inner}]")))


def top_tags(dictionary: DataFrame, n: int = 5) -> DataFrame:
    """cpos, n: the n commonest tags of the dictionary (A2)."""
    return top_n(_counted(dictionary).groupBy("cpos").agg(F.count("*").alias("n")), "n", "cpos", n)


def msr_frequency(dictionary: DataFrame) -> DataFrame:
    """cpos, msr (tag|features), n, without empty features (A3)."""
    return dictionary.filter("feat_str not in ('', '_')").groupBy("cpos", F.concat_ws("|", "cpos", "feat_str").alias("msr")).agg(F.count("*").alias("n"))


def oov_msrs(dictionary: DataFrame, n: int = 10, tags: int = 5) -> DataFrame:
    """rank, oov_msr: the n commonest tag|tag|features over the top tags, padded by tag|tag| in the order of tags (A4)."""
    top = top_tags(dictionary, tags)
    found = msr_frequency(dictionary).join(F.broadcast(top.select("cpos")), "cpos").select(F.concat_ws("|", "cpos", "msr").alias("oov_msr"), "n", F.lit(0).alias("pad"))
    found = found.orderBy(F.desc("n"), "oov_msr").limit(n)
    padding = top.select(F.concat(F.col("cpos"), F.lit("|"), F.col("cpos"), F.lit("|")).alias("oov_msr"), "n", F.lit(1).alias("pad"))
    both = found.unionByName(padding).withColumn("one", F.lit(1))  # n + tags rows
    return top_n_per(both.withColumn("order", -F.col("pad")), ["one"], "order", [F.desc("n"), "oov_msr"], n).select("rank", "oov_msr")


def oov_msrs_per_tag(dictionary: DataFrame, n: int = 5, tags: int = 5) -> DataFrame:
    """cpos, rank, oov_msr: the n commonest of each top tag (A4, by tag)."""
    found = msr_frequency(dictionary).join(F.broadcast(top_tags(dictionary, tags).select("cpos")), "cpos")
    return top_n_per(found, ["cpos"], "n", ["msr"], n).select("cpos", "rank", F.concat_ws("|", "cpos", "msr").alias("oov_msr"))


def lookup(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tokens (form, ...) with each analysis of their form, and oov (no analysis; its columns are null)."""
    forms = tokens.select("form").distinct()
    found = forms.join(dictionary.select("form", *(F.col(c).alias(f"a_{c}") for c in ANALYSIS)), "form", "left").withColumn("oov", F.col("a_cpos").isNull())
    return tokens.join(found, "form")


def _cuts(forms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """forms (form) -> form, prefix, host: each known prefix of any length with what follows it. The lengths that occur are one row."""
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths"))
    cut = forms.select("form").distinct().join(F.broadcast(lengths)).select("form", F.explode("lengths").alias("n")).filter("n > 0 and n < length(form)")
    return cut.select("form", F.expr("left(form, n)").alias("prefix"), F.expr("substring(form, n + 1)").alias("host")).join(prefixes.select("prefix").distinct(), "prefix")


def prefix_lookup(forms: DataFrame, prefixes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """forms (form) -> form, prefix, host and the host's analyses: every known prefix, of any length, followed by a known host, or by a number.

    prefixes (prefix) is a closed list of a language; Spark broadcasts it where its size allows."""
    cut = _cuts(forms, prefixes)
    known = cut.join(dictionary.withColumnRenamed("form", "host"), "host")
    numbers = cut.withColumn("cpos", regex_tag("host")).filter("cpos is not null").join(dictionary.select(F.col("form").alias("host")).distinct(), "host", "left_anti")
    return known.select("form", "prefix", "host", *ANALYSIS).unionByName(numbers.select("form", "prefix", "host", F.lit("").alias("lemma"), "cpos", F.lit("").alias("feat_str")))


def expand_oov(forms: DataFrame, known: DataFrame, oov: DataFrame) -> DataFrame:
    """forms without a row in known, each with every reading of oov (oov_msr): form, cpos, feat_str (J3). oov is a list of at most n rows."""
    unknown = forms.select("form").distinct().join(known.select("form").distinct(), "form", "left_anti")
    return with_readings(unknown, oov)


def with_readings(forms: DataFrame, oov: DataFrame) -> DataFrame:
    """Each form with each reading: tag of the first part of oov_msr, features of what follows the second."""
    parts = F.split("oov_msr", r"\|")
    readings = oov.select(parts[0].alias("cpos"), F.array_join(F.filter(parts, lambda x, i: i > 1), "|").alias("feat_str")).agg(F.collect_list(F.struct("cpos", "feat_str")).alias("readings"))
    return forms.join(F.broadcast(readings)).select("form", F.explode("readings").alias("r")).select("form", "r.cpos", "r.feat_str")


def dope(forms: DataFrame, dictionary: DataFrame, oov: DataFrame, tags: int = 5) -> DataFrame:
    """Known forms with a reading of a top tag, each with every out-of-vocabulary reading."""
    open_forms = dictionary.join(F.broadcast(top_tags(dictionary, tags).select("cpos")), "cpos", "left_semi").select("form").distinct()
    return with_readings(forms.select("form").distinct().join(open_forms, "form", "left_semi"), oov)


def always_propn(forms: DataFrame, prefixes: DataFrame, oov: DataFrame) -> DataFrame:
    """form, prefix (empty for none), host, cpos, feat_str: proper-noun and other open readings of every form, and of every host of two characters or more behind a known prefix."""
    whole = forms.select("form").distinct().select("form", F.lit("").alias("prefix"), F.col("form").alias("host"))
    hosts = whole.unionByName(_cuts(forms, prefixes).filter("length(host) >= 2").select("form", "prefix", "host"))
    made = with_readings(hosts.select(F.col("host").alias("form")).distinct(), oov).withColumnRenamed("form", "host")
    return hosts.join(made, "host").select("form", "prefix", "host", "cpos", "feat_str")


def analysis_stats(tokens: DataFrame, dictionary: DataFrame, by: list[str]) -> DataFrame:
    """By group: n_tokens, n_oov, n_forms, n_oov_forms (A5). Tokens are counted by form before the join with the dictionary."""
    counts = tokens.groupBy(*by, "form").agg(F.count("*").alias("n"))
    known = dictionary.select("form").distinct().withColumn("known", F.lit(True))
    flagged = counts.join(known, "form", "left").withColumn("oov", F.col("known").isNull())
    return flagged.groupBy(*by).agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("oov"), F.col("n")).otherwise(0)).alias("n_oov"), F.count("*").alias("n_forms"), F.count_if("oov").alias("n_oov_forms"))


def ambiguity(edges: DataFrame, sent: list[str], by: list[str]) -> DataFrame:
    """By group: n_sentences, n_tokens, n_morphs, morphs_per_token (A6). edges: one row for each morpheme of each token."""
    per = edges.groupBy(*by, *sent).agg(F.countDistinct("tok_no").alias("t"), F.count("*").alias("m"))
    return per.groupBy(*by).agg(F.count("*").alias("n_sentences"), F.sum("t").alias("n_tokens"), F.sum("m").alias("n_morphs")).withColumn("morphs_per_token", F.round(F.try_divide("n_morphs", "n_tokens"), 6))


def vocabulary(values: DataFrame, value: str, order: list[str]) -> DataFrame:
    """value, id, n: dense ids in the order of first occurrence (A16). order are columns of values."""
    from ..plans.ranking import global_number

    first = values.groupBy(value).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).select(value, "n", *(F.col(f"first.{c}").alias(f"_{c}") for c in order))
    return global_number(first, [f"_{c}" for c in order], "id").select(value, "id", "n")


def encode(values: DataFrame, vocab: DataFrame, value: str) -> DataFrame:
    """values with the id of value."""
    return values.join(vocab.select(value, "id"), value)


def analyze_dictionary(tokens: DataFrame, dictionary: DataFrame, oov: DataFrame, with_dope: bool = False) -> DataFrame:
    """Dictionary analyser (G11): tokens with every reading (cpos, feat_str, lemma) and oov, distinct forms analysed once."""
    forms = tokens.select("form").distinct()
    known = forms.join(dictionary, "form").select("form", "cpos", "feat_str", "lemma", F.lit(False).alias("oov"))
    made = expand_oov(forms, dictionary, oov).select("form", "cpos", "feat_str", F.lit("_").alias("lemma"), F.lit(True).alias("oov"))
    out = known.unionByName(made)
    if with_dope:
        out = out.unionByName(dope(forms, dictionary, oov).select("form", "cpos", "feat_str", F.lit("_").alias("lemma"), F.lit(False).alias("oov"))).distinct()
    return tokens.join(out, "form")


MORPH = ["form", *ANALYSIS]


def _morph(form: Column, lemma: Column | str = "", cpos: Column | str = "", feat_str: Column | str = "") -> Column:
    text = lambda c: F.coalesce(c, F.lit("")) if isinstance(c, Column) else F.lit(c)
    return F.struct(text(form).alias("form"), text(lemma).alias("lemma"), text(cpos).alias("cpos"), text(feat_str).alias("feat_str"))


def lexicon_entries(lexicon: DataFrame) -> DataFrame:
    """Rows of read_lexicon -> token, morphs: the host, and where its suffix is a pronoun of its own, the word between (by the host's tag, if any) and the pronoun.

    The host of such a chain has its lemma for a form. Tags of fixed.SUFFIX_IN_HOST take the suffix' features themselves; suffixes whose code begins neither with
    - nor with S (S_ANP is none) add nothing. Definite hosts have def=D among their features."""
    joined = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x != ""), "|")
    tag, code, suffix = F.col("tag"), F.coalesce("suffix_code", F.lit("")), F.col("suffix")
    within = tag.isin(*fixed.SUFFIX_IN_HOST) & (code != "")
    alone = ~within & (F.startswith(code, F.lit("-")) | (F.startswith(code, F.lit("S")) & ~F.startswith(code, F.lit("S_ANP"))))
    feats = joined(F.col("feat_str"), F.when(F.col("definite"), "def=D").otherwise(""))
    host = _morph(F.when(alone, F.col("lemma")).otherwise(F.col("token")), F.col("lemma"), tag, F.when(within, joined(feats, F.coalesce(suffix["feat_str"], F.lit("")))).otherwise(feats))
    bridge, pronoun = _morph(suffix["bridge"], suffix["bridge"], fixed.BRIDGE_TAG), _morph(suffix["form"], suffix["form"], fixed.PRONOUN_TAG, suffix["feat_str"])
    chain = F.when(~alone, F.array(host)).when(suffix["bridge"] == "", F.array(host, pronoun)).otherwise(F.array(host, bridge, pronoun))
    return lexicon.select("token", chain.alias("morphs")).distinct()


def learn_entries(morphs: DataFrame, token: list[str]) -> DataFrame:
    """Distinct analyses of several morphemes from annotated tokens (token's columns, form: the token's, morph_idx, morph, lemma, cpos, feat_str) -> token, morphs (A1)."""
    each = morphs.groupBy(*token, "form").agg(F.array_sort(F.collect_list(F.struct("morph_idx", _morph(F.col("morph"), F.col("lemma"), F.col("cpos"), F.col("feat_str")).alias("m")))).alias("a"))
    return each.select(F.col("form").alias("token"), F.transform("a", lambda x: x["m"]).alias("morphs")).distinct()


def learn_from_lattices(edges: DataFrame, tokens: DataFrame, sent: list[str]) -> DataFrame:
    """The same from lattices of one path a token (sent, tok_no, from_node, to_node, form, lemma, cpos, feat_str) and raw tokens (sent, tok_no, form), which are
    joined by their places. The job fails where a sentence has more tokens on one side (A1)."""
    path = edges.groupBy(*sent, "tok_no").agg(F.array_sort(F.collect_list(F.struct("from_node", "to_node", _morph(F.col("form"), F.col("lemma"), F.col("cpos"), F.col("feat_str")).alias("m")))).alias("a"))
    both = tokens.select(*sent, "tok_no", "form").join(path, [*sent, "tok_no"], "full_outer")
    checked = F.expr("if(form is null or a is null, raise_error('numbers of tokens differ between lattices and raw text'), form)")
    return both.select(checked.alias("token"), F.transform("a", lambda x: x["m"]).alias("morphs")).distinct()


def learn_from_rows(rows: DataFrame, token: str, edges: str) -> DataFrame:
    """learn_from_lattices of rows that are a token each: its raw form and the edges of its one path (from_node, to_node, form, lemma, cpos, feat_str). The job fails where either is missing."""
    morphs = F.transform(F.array_sort(edges), lambda e: _morph(e["form"], e["lemma"], e["cpos"], e["feat_str"]))
    checked = F.expr(f"if({token} is null or {edges} is null, raise_error('numbers of tokens differ between lattices and raw text'), {token})")
    return rows.select(checked.alias("token"), morphs.alias("morphs")).distinct()


def _known_splits(tokens: DataFrame, entries: DataFrame, prefixes: DataFrame, oov: DataFrame) -> DataFrame:
    """Distinct forms -> form, oov, found: an array of (prefix, host, before: the prefix' morphemes, morphs: a reading of the host).

    Hosts behind each form's prefixes (and the form itself) are looked up in one join; only those with readings go back to their forms, where the rest is decided
    in the form's row. The prefixes, a closed list, are one row."""
    forms = tokens.select("form").distinct()
    before = prefixes.select("prefix", F.col("morphs").alias("before")) if "morphs" in prefixes.columns else prefixes.select("prefix", F.array(F.struct(F.col("prefix").alias("form"), F.lit("PREFIX").alias("cpos"))).alias("before"))
    before = before.select("prefix", F.transform("before", lambda m: _morph(m["form"], "", m["cpos"])).alias("before")).filter("prefix <> ''")
    nothing = F.array().cast(before.schema["before"].dataType)
    listed = before.groupBy("prefix").agg(F.collect_set("before").alias("befores")).agg(F.collect_list(F.struct("prefix", "befores")).alias("listed"))  # one row
    parts = F.split("oov_msr", r"\|")
    opened = oov.select(F.struct(parts[0].alias("cpos"), F.array_join(F.filter(parts, lambda x, i: i > 1), "|").alias("feat_str")).alias("r")).agg(F.collect_list("r").alias("open"))  # one row
    fits = lambda p: F.col("punct").isNull() & F.startswith(F.col("form"), p["prefix"]) & (F.length(p["prefix"]) < F.length("form"))
    words = forms.withColumn("punct", punct_tag("form")).join(F.broadcast(listed)).withColumn("listed", F.filter("listed", fits))
    rest = lambda p: F.substr(F.col("form"), F.length(p["prefix"]) + 1)
    asked = words.filter("punct is null").select(F.inline(F.concat(F.array(F.struct(F.lit("").alias("prefix"), F.col("form").alias("host"))), F.transform("listed", lambda p: F.struct(p["prefix"].alias("prefix"), rest(p).alias("host"))))))
    readings = entries.select(F.col("token").alias("host"), F.transform("morphs", lambda m: _morph(m["form"], m["lemma"], m["cpos"], m["feat_str"])).alias("morphs")).groupBy("host").agg(F.collect_set("morphs").alias("readings"))
    hits = asked.join(readings, "host").groupBy(F.concat("prefix", "host").alias("form")).agg(F.collect_list(F.struct("prefix", "readings")).alias("hits"))
    each = words.join(hits, "form", "left").join(F.broadcast(opened))

    def cut(prefix: Column, host: Column, before: Column) -> Column:
        number = F.when(regex_tag(host).isNotNull(), F.array(F.array(_morph(host, "", regex_tag(host)))))
        known = F.coalesce(F.get(F.filter("hits", lambda h: h["prefix"] == prefix), F.lit(0))["readings"], number)
        mark = F.array(F.array(_morph(F.col("form"), "", F.col("punct"))))
        return F.struct(prefix.alias("prefix"), host.alias("host"), before.alias("before"), F.when(F.col("punct").isNotNull(), mark).otherwise(known).alias("readings"))

    split = F.flatten(F.transform("listed", lambda p: F.transform(p["befores"], lambda b: cut(p["prefix"], rest(p), b))))
    each = each.withColumn("cuts", F.concat(F.array(cut(F.lit(""), F.col("form"), nothing)), split))
    each = each.withColumn("oov", ~F.exists("cuts", lambda c: c["readings"].isNotNull()))
    use = """transform(filter(cuts, c -> c.readings is not null or c.prefix = '' or (oov and length(c.host) >= 2)),
        c -> struct(c.prefix, c.host, c.before, coalesce(c.readings, transform(open, r -> array(struct(c.host as form, '' as lemma, r.cpos, r.feat_str)))) as readings))"""
    found = f"flatten(transform({use}, c -> transform(c.readings, m -> struct(c.prefix, c.host, c.before, m as morphs))))"
    return each.select("form", "oov", F.expr(found).alias("found"))


def analyze_morph_sets(tokens: DataFrame, entries: DataFrame, prefixes: DataFrame, oov: DataFrame) -> DataFrame:
    """analyze_morphs with all readings of a form in one row: form, analyses (array of morphs), oov."""
    return _known_splits(tokens, entries, prefixes, oov).select("form", F.array_distinct(F.transform("found", lambda x: F.concat(x["before"], x["morphs"]))).alias("analyses"), "oov")


def analyze_morphs(tokens: DataFrame, entries: DataFrame, prefixes: DataFrame, oov: DataFrame) -> DataFrame:
    """Lexicon analyser over entries of several morphemes (G10): form, morphs (array of form, lemma, cpos, feat_str), oov for each distinct form of tokens.

    entries (token, morphs), as lexicon_entries, learn_entries or read_ud_lexicon give them; prefixes (prefix, and morphs as read_prefixes gives them; without, a
    prefix is one morpheme tagged PREFIX) may be of any length. Rules are those of analyze_lexicon; token_lattices makes lattices of the result."""
    return analyze_morph_sets(tokens, entries, prefixes, oov).select("form", F.explode("analyses").alias("morphs"), "oov")


def analyze_lexicon(tokens: DataFrame, dictionary: DataFrame, prefixes: DataFrame, oov: DataFrame) -> DataFrame:
    """Lexicon analyser (G10): punctuation has its name alone; else lexicon or number readings, or open readings where there are none; and prefix splits.

    form, prefix (empty for none), host, cpos, feat_str, oov (neither lexicon, number nor split knows the form: then splits have open readings too) for each
    token. Distinct forms are cut and looked up once."""
    entries = dictionary.select(F.col("form").alias("token"), F.array(_morph(F.col("form"), F.col("lemma"), F.col("cpos"), F.col("feat_str"))).alias("morphs"))
    each = _known_splits(tokens, entries, prefixes.select("prefix").distinct(), oov)
    flat = F.array_distinct(F.transform("found", lambda x: F.struct(x["prefix"], x["host"], x["morphs"][0]["cpos"].alias("cpos"), x["morphs"][0]["feat_str"].alias("feat_str"))))
    return tokens.join(each.select("form", "oov", flat.alias("found")), "form").select("*", F.explode("found").alias("f")).select(*tokens.columns, "f.*", "oov")


def split_morphs(analyses: DataFrame) -> DataFrame:
    """Rows of analyze_lexicon or analyze_dictionary -> form, morphs (array of form, lemma, cpos, feat_str), oov: the prefix, if any, as a morpheme of its own tagged PREFIX, then the host."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in analyses.columns else F.lit("")
    host = F.col("host") if "host" in analyses.columns else F.col("form")
    morph = lambda form, lemma, cpos, feats: F.struct(form.alias("form"), lemma.alias("lemma"), cpos.alias("cpos"), feats.alias("feat_str"))
    own = morph(host, text("lemma"), F.col("cpos"), text("feat_str"))
    before = morph(text("prefix"), F.lit(""), F.lit("PREFIX"), F.lit(""))
    return analyses.select("form", F.when(text("prefix") != "", F.array(before, own)).otherwise(F.array(own)).alias("morphs"), "oov").distinct()


def entry_morphs(tokens: DataFrame, entries: DataFrame, oov: DataFrame) -> DataFrame:
    """Dictionary entries of several morphemes (token, morphs, as read_ud_lexicon gives them) -> form, morphs, oov for each distinct form of tokens; forms without an entry have the readings of oov."""
    forms = tokens.select("form").distinct()
    morph = lambda m: F.struct(*(F.coalesce(m[c], F.lit("")).alias(c) for c in ("form", *ANALYSIS)))
    known = forms.join(entries.select(F.col("token").alias("form"), F.transform("morphs", morph).alias("morphs")), "form").select("form", "morphs", F.lit(False).alias("oov")).distinct()
    made = expand_oov(forms, known, oov).select("form", F.array(F.struct("form", F.lit("").alias("lemma"), "cpos", "feat_str")).alias("morphs"), F.lit(True).alias("oov"))
    return known.unionByName(made)


def entry_morph_sets(tokens: DataFrame, entries: DataFrame, oov: DataFrame) -> DataFrame:
    """entry_morphs with all readings of a form in one row: form, analyses (array of morphs), oov."""
    morph = lambda m: F.struct(*(F.coalesce(m[c], F.lit("")).alias(c) for c in MORPH))
    known = entries.select(F.col("token").alias("form"), F.transform("morphs", morph).alias("m")).groupBy("form").agg(F.collect_set("m").alias("known"))
    parts = F.split("oov_msr", r"\|")
    opened = oov.select(F.struct(parts[0].alias("cpos"), F.array_join(F.filter(parts, lambda x, i: i > 1), "|").alias("feat_str")).alias("r")).agg(F.collect_list("r").alias("open"))  # one row
    each = tokens.select("form").distinct().join(known, "form", "left").join(F.broadcast(opened))
    made = F.transform("open", lambda r: F.array(_morph(F.col("form"), "", r["cpos"], r["feat_str"])))
    return each.select("form", F.coalesce("known", made).alias("analyses"), F.col("known").isNull().alias("oov"))


def row_lattices(sets: DataFrame) -> DataFrame:
    """Rows of analyze_morph_sets or entry_morph_sets -> token, oov, edges (array of from_node, to_node, form, cpos, lemma, feat_str): the lattice of each form, in its row."""
    from .lattice import build_rows

    return build_rows(sets.withColumnRenamed("form", "token"), "analyses", ["lemma", "feat_str"]).select("token", "oov", "edges")


def token_lattices(tokens: DataFrame, analyses: DataFrame, sent: list[str]) -> DataFrame:
    """tokens (sent, tok_no, form) and analyses (form, morphs, oov) -> lattice edges: sent, tok_no, token, oov, from_node, to_node, form, lemma, cpos, feat_str.

    Lattices are built once for each distinct form and joined back; nodes are those of the sentence. Sinks write them as they are."""
    from .lattice import build, renumber

    named = analyses.withColumnRenamed("form", "token")
    built = build(named, ["token"], ["lemma", "feat_str"]).join(named.groupBy("token").agg(F.max("oov").alias("oov")), "token")
    edges = tokens.select(*sent, "tok_no", F.col("form").alias("token")).join(built, "token")
    return renumber(edges, sent).select(*sent, "tok_no", "token", "oov", "from_node", "to_node", "form", "lemma", "cpos", "feat_str")


def analyze_with(tokens: DataFrame, analyser: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """tokens with the readings of an analyser of one's own (E4): it gets the distinct forms (form) and returns form with columns of its readings, as many rows as it likes; forms without a row keep nulls."""
    forms = tokens.select("form").distinct()
    return tokens.join(forms.join(analyser(forms), "form", "left"), "form")
