"""Queries over the derived corpus, one for each operator, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import evaluation, lexicon
from ..sources import derived
from ..sources.derived import EDGES_SQL, MORPHS_SQL, SENT, TOKENS_SQL
from . import ranking
from .tree_queries import _once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKEN = [*SENT, "tok_no"]


def query(sql: str | None = None):
    """Register a query by its function's name; sql is its SQL equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return derived.documents(spark, d)


def _morphs(spark, d):
    return derived.morphs(_docs(spark, d))


def _dictionary(m):
    return lexicon.learn_dictionary(m.filter("doc_id % 10 <> 0"))


def _edges(spark, d):
    return derived.edges(derived.tokens(_docs(spark, d)))


FORM_SQL = f"WITH {MORPHS_SQL}, f AS (SELECT form, cpos, lemma, feat_str, lang, count(*) AS n FROM morph GROUP BY ALL) "
DICT_SQL = f"WITH {MORPHS_SQL}, train AS MATERIALIZED (SELECT DISTINCT form, lemma, cpos, feat_str FROM morph WHERE doc_id % 10 <> 0), test AS (SELECT * FROM morph) "


def _forms(spark, d):
    return _morphs(spark, d).groupBy("form", "cpos", "lemma", "feat_str", "lang").agg(F.count("*").alias("n"))


# --- sources and scalars


@query(f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT line_no) AS n_sentences, max(tok_no) AS longest, sum(length(form)) AS n_chars FROM tok GROUP BY doc_id")
def s1_tokens(spark, d):
    return derived.tokens(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("line_no").alias("n_sentences"), F.max("tok_no").alias("longest"), F.sum(F.length("form")).alias("n_chars"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, line_no, string_agg(form, ' ' ORDER BY tok_no) AS sentence FROM tok GROUP BY doc_id, line_no")
def b16_sentences(spark, d):
    t = derived.tokens(_docs(spark, d)).groupBy(*SENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "form"))), lambda x: x["form"]).alias("forms"))
    return t.select(*SENT, text.join_sentence("forms").alias("sentence"))


@query(FORM_SQL + "SELECT form, lang, string_split(string_split(feat_str, '|gen=')[2], '|')[1] AS gen, CASE WHEN contains(feat_str, 'suf_gen') THEN 'F,M' END AS suf_gen FROM f GROUP BY ALL")
def b1_parse_feats(spark, d):
    f = _forms(spark, d).select("form", "lang", text.parse_feats("feat_str").alias("m"))
    return f.select("form", "lang", F.col("m")["gen"].alias("gen"), F.try_element_at("m", F.lit("suf_gen")).alias("suf_gen")).distinct()


@query(FORM_SQL + "SELECT DISTINCT feat_str, replace(feat_str, '|suf_gen=F|suf_gen=M', '|suf_gen=F,M') AS formatted FROM f")
def b2_format_feats(spark, d):
    return _morphs(spark, d).select("feat_str").distinct().select("feat_str", text.format_feats(text.parse_feats("feat_str")).alias("formatted"))


@query(FORM_SQL + "SELECT DISTINCT feat_str, split_part(feat_str, '|suf_gen', 1) AS host, CASE WHEN contains(feat_str, 'suf_gen') THEN 'suf_gen=F,M' ELSE '_' END AS suffix FROM f")
def b3_host_suffix(spark, d):
    m = text.parse_feats("feat_str")
    return _morphs(spark, d).select("feat_str").distinct().select("feat_str", text.format_feats(text.host_feats(m)).alias("host"), text.format_feats(text.suffix_feats(m)).alias("suffix"))


@query(FORM_SQL + "SELECT DISTINCT feat_str, array_to_string(list_sort(list_distinct(string_split(feat_str || '|gen=F|zz=1', '|'))), '|') AS merged, feat_str || '|x=y' AS added, array_to_string(list_filter(string_split(feat_str, '|'), lambda p: NOT starts_with(p, 'suf_gen=')), '|') AS dropped FROM f")
def b4_merge_feats(spark, d):
    return _morphs(spark, d).select("feat_str").distinct().select("feat_str", text.merge_feats("feat_str", F.lit("gen=F|zz=1")).alias("merged"), text.add_feat("feat_str", F.lit("x=y")).alias("added"), text.drop_feat("feat_str", "suf_gen").alias("dropped"))


_TAG_OF = "list_extract(['NN', 'VB', 'JJT', 'IN', 'ZZ'], 1 + length(form) % 5)"


@query(FORM_SQL + f"SELECT DISTINCT form, CASE {_TAG_OF} WHEN 'NN' THEN 'NOUN' WHEN 'VB' THEN 'VERB' WHEN 'JJT' THEN 'ADJ-Definite=Cons' WHEN 'IN' THEN 'ADP' END AS tag FROM f")
def b5_universal_tag(spark, d):
    tag = F.element_at(F.array(*map(F.lit, ("NN", "VB", "JJT", "IN", "ZZ"))), (1 + F.length("form") % 5).cast("int"))
    return _forms(spark, d).select("form", text.universal_tag(tag).alias("tag")).distinct()


@query(FORM_SQL + "SELECT DISTINCT form, CASE WHEN length(form) % 2 = 1 THEN 'Gender=Fem' ELSE 'Gender=Masc' END || '|' || CASE WHEN ends_with(form, 's') THEN 'Number=Plur' ELSE 'Number=Sing' END AS feats FROM f")
def b6_universal_feats(spark, d):
    return _forms(spark, d).select("form", text.universal_feats(F.array_join(F.filter(text.feature_pairs("feat_str"), lambda p: ~F.rlike(p, F.lit("^suf_"))), "|")).alias("feats")).distinct()


# features that the table does not know, beside the universal ones
@query(FORM_SQL + "SELECT DISTINCT form, feat_str, array_to_string(list_filter(string_split(feat_str, '|'), lambda p: starts_with(p, 'Lang=') OR starts_with(p, 'suf_')), ',') AS unknown FROM f")
def b6_unknown_feats(spark, d):
    return _forms(spark, d).select("form", "feat_str", F.array_join(text.unknown_feats("feat_str"), ",").alias("unknown")).distinct()


@query(FORM_SQL + "SELECT DISTINCT form, 'NN' AS tag, CASE WHEN length(form) % 2 = 1 THEN 'gen=F' ELSE 'gen=M' END || '|num=S|per=' || (1 + length(form) % 3) AS feat_str FROM f")
def b7_parse_msr(spark, d):
    code = F.concat(F.lit("NN-S-PAAL-"), (1 + F.length("form") % 3).cast("string"), F.when(F.length("form") % 2 == 1, F.lit("-F-zz")).otherwise(F.lit("-M")))
    return _forms(spark, d).select("form", text.parse_msr(code).alias("m")).select("form", "m.tag", "m.feat_str").distinct()


@query(FORM_SQL + "SELECT DISTINCT form, CASE WHEN length(form) % 2 = 1 THEN 'את' ELSE 'של' END AS bridge, CASE length(form) % 3 WHEN 0 THEN 'היא' WHEN 1 THEN 'אתה' ELSE 'הם' END AS pronoun FROM f")
def b8_pronoun(spark, d):
    code = F.element_at(F.array(F.lit("S-F-S-3"), F.lit("S-M-S-2"), F.lit("S-zz")), (1 + F.length("form") % 3).cast("int"))
    host = F.when(F.length("form") % 2 == 1, F.lit("VB")).otherwise(F.lit("NN"))
    return _forms(spark, d).select("form", text.parse_msr_suffix(host, code).alias("p")).select("form", "p.bridge", F.col("p.form").alias("pronoun")).distinct()


_CLASS_SQL = " || ".join(f"CASE WHEN regexp_matches(form, '{c}') THEN 't' ELSE 'f' END" for c in text.CLASSES)


@query(FORM_SQL + f"SELECT {_CLASS_SQL} AS signature, count(DISTINCT form) AS n_forms, sum(n) AS n_tokens FROM f GROUP BY 1")
def b9_signature(spark, d):
    return _forms(spark, d).withColumn("signature", text.signature("form")).groupBy("signature").agg(F.countDistinct("form").alias("n_forms"), F.sum("n").alias("n_tokens"))


@query(FORM_SQL + "SELECT affix, count(*) AS n FROM (SELECT DISTINCT form, unnest([left(form, 1), left(form, 2), left(form, 3), '-' || right(form, 1), '-' || right(form, 2)]) AS affix FROM f) GROUP BY affix")
def b10_affixes(spark, d):
    a = _forms(spark, d).select("form", F.explode(F.concat(text.prefixes("form", 3), F.transform(text.suffixes("form", 2), lambda s: F.concat(F.lit("-"), s)))).alias("affix")).distinct()
    return a.groupBy("affix").agg(F.count("*").alias("n"))


_MARKS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PUNCTUATION.items())


@query(FORM_SQL + f"SELECT DISTINCT form, CASE form {_MARKS} ELSE translate(regexp_replace(form, '[^0-9\"%.,]', '', 'g'), '\"%', 'UO') END AS latin FROM f")
def b11_to_latin(spark, d):
    return _forms(spark, d).select("form", text.to_latin("form").alias("latin")).distinct()


_ASCII = "translate(form, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_LAST = "translate(right(letters, 1), '" + fixed.BEFORE_FINAL + "', '" + fixed.AS_FINAL + "')"


# the letters of capitals, with a final one at the end, and back
@query(FORM_SQL + f""", h AS (SELECT form, translate(regexp_replace({_ASCII}, '[^{fixed.LATIN.replace("'", "''")}]', '', 'g'), '{fixed.LATIN.replace("'", "''")}', '{fixed.LETTERS}') AS letters FROM f),
k AS (SELECT form, CASE WHEN letters = '' THEN '' ELSE left(letters, length(letters) - 1) || {_LAST} END AS letters FROM h),
m AS (SELECT form, CASE WHEN letters = '' THEN coalesce(CASE {_ASCII} {" ".join(f"WHEN '{v}' THEN '{k}'" for k, v in fixed.PUNCTUATION.items())} END, '') ELSE letters END AS letters FROM k)
SELECT DISTINCT form, letters, CASE letters {_MARKS} ELSE translate(letters, '{fixed.LETTERS + fixed.FINAL_LETTERS}', '{(fixed.LATIN + fixed.FINAL_LATIN).replace("'", "''")}') END AS latin FROM m""")
def b11_letters(spark, d):
    upper = F.translate("form", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = text.from_latin(upper)
    return _forms(spark, d).select("form", letters.alias("letters"), text.to_latin(letters).alias("latin")).distinct()


@query(FORM_SQL + "SELECT DISTINCT lemma, CASE WHEN lemma = '' THEN '_' ELSE lemma END AS shown, CASE WHEN regexp_matches(lemma, '^[0-9]+$') THEN TRY_CAST(lemma AS INTEGER) END AS number FROM f")
def b12_underscore(spark, d):
    return _forms(spark, d).select("lemma", text.to_underscore("lemma").alias("shown"), F.when(F.rlike("lemma", F.lit("^[0-9]+$")), text.parse_int("lemma")).alias("number")).distinct()


@query(FORM_SQL + "SELECT CASE WHEN n > 10 THEN 6 WHEN n > 5 THEN 5 ELSE n END AS bucket, count(*) AS n_forms FROM (SELECT abs(length(form) - 3) AS n FROM (SELECT DISTINCT form FROM f)) GROUP BY 1")
def b14_distance(spark, d):
    return _forms(spark, d).select("form").distinct().groupBy(text.distance_bucket(F.length("form"), F.lit(3)).alias("bucket")).agg(F.count("*").alias("n_forms"))


@query(FORM_SQL + "SELECT CASE WHEN form < lemma THEN -1 WHEN form > lemma THEN 1 ELSE 0 END AS cmp, sign(length(form) - 4) AS s, greatest(length(form), n) AS top, sum(least(length(form), n)) AS low FROM f GROUP BY ALL")
def b18_small_math(spark, d):
    f = _forms(spark, d).select(text.compare("form", "lemma").alias("cmp"), text.sign(F.length("form") - 4).alias("s"), F.greatest(F.length("form"), "n").alias("top"), F.least(F.length("form"), "n").alias("low"))
    return f.groupBy("cmp", "s", "top").agg(F.sum("low").alias("low"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, line_no, tok_no, form FROM tok WHERE line_no <= 2")
def p1_first_sentences(spark, d):
    return derived.tokens(_docs(spark, d)).filter("line_no <= 2").select(*TOKEN, "form")


@query(f"WITH {TOKENS_SQL} SELECT doc_id, tok_no, form FROM tok WHERE line_no = 3")
def p2_sentence(spark, d):
    return derived.tokens(_docs(spark, d)).filter("line_no = 3").select("doc_id", "tok_no", "form")


@query(FORM_SQL + "SELECT form, sum(n) AS n FROM f WHERE NOT regexp_matches(form, '^[,?!:;]$|^[.]+$|^[`]+$|^['']+$|^…$') GROUP BY form")
def p3_no_punct(spark, d):
    return _forms(spark, d).filter(~F.rlike("form", F.lit(evaluation.NO_PUNCT))).groupBy("form").agg(F.sum("n").alias("n"))


@query(FORM_SQL + r"SELECT DISTINCT form, CASE WHEN regexp_matches(form, '^[0-9]+(\.[0-9]+)?$|^[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?$') THEN 'CD' WHEN regexp_matches(form, '[0-9]') THEN 'NCD' END AS tag FROM f WHERE regexp_matches(form, '[0-9]')")
def p4_regex_tag(spark, d):
    return _forms(spark, d).select("form", text.regex_tag("form").alias("tag")).filter("tag is not null").distinct()


# the forms themselves and their last characters, where most marks are
@query(FORM_SQL + f"SELECT CASE form {_MARKS} END AS tag, CASE right(form, 1) {_MARKS} END AS last, CASE WHEN CASE right(form, 1) {_MARKS} END IS NULL THEN NULL ELSE 'PUNCT' END AS universal, right(form, 1) AS mark, sum(n) AS n FROM f GROUP BY ALL")
def p5_punct_tag(spark, d):
    mark = F.right("form", F.lit(1))
    return _forms(spark, d).groupBy(text.punct_tag("form").alias("tag"), text.punct_tag(mark).alias("last"), text.punct_tag(mark, universal=True).alias("universal"), mark.alias("mark")).agg(F.sum("n").alias("n"))


@query(FORM_SQL + "SELECT cpos, cpos IN ('PUNCT', 'NUM', 'PROPN') AS open_class, count(*) AS n FROM f GROUP BY ALL")
def p6_open_class(spark, d):
    return _forms(spark, d).groupBy("cpos", text.is_open_class("cpos", "UD").alias("open_class")).agg(F.count("*").alias("n"))


_P = {k: "||'_'||".join(v.split()) for k, v in {
    "Form": "form", "Lemma": "lemma", "Form_Prop": "form feat_str", "POS": "cpos", "POS_Prop": "cpos feat_str", "Form_POS_Prop": "form cpos feat_str", "Lemma_POS_Prop": "lemma cpos feat_str",
    "Form_Lemma_POS_Prop": "form lemma cpos feat_str", "Form_POS": "form cpos", "Funcs_Main_POS_Both_Prop_WLemma": "lemma cpos feat_str", "Funcs_All_WLemma": "form lemma cpos cpos feat_str",
}.items()}
_OPEN = {"Funcs_Main_POS": ("POS", "Form_POS"), "Funcs_Main_POS_Prop": ("POS_Prop", "Form_POS_Prop"), "Funcs_Main_POS_No_Prop": ("POS", "Form_POS_Prop"), "Funcs_Main_POS_Both_Prop": ("POS_Prop", "Form_POS_Prop")}
_P |= {k: f"CASE WHEN cpos IN ('PUNCT', 'NUM', 'PROPN') THEN {_P[a]} ELSE {_P[b]} END" for k, (a, b) in _OPEN.items()}
_P["Funcs_Lemma_Main_POS"] = "CASE WHEN cpos IN ('PUNCT', 'NUM', 'PROPN') THEN cpos ELSE lemma || '_' || cpos END"
_P["Funcs_Main_POS_Both_Prop_Clitic"] = f"CASE WHEN cpos NOT IN ('PUNCT', 'NUM', 'PROPN') THEN {_P['Form_POS_Prop']} WHEN length(form) > 1 AND ends_with(form, '_') THEN 's_' || {_P['POS_Prop']} ELSE {_P['POS_Prop']} END"


# all projections of each morpheme, of which those of open classes also come with a mark of clitics behind the form
@query(FORM_SQL + ", g AS (SELECT form, lemma, cpos, feat_str, n FROM f UNION ALL SELECT form || '_', lemma, cpos, feat_str, n FROM f WHERE cpos = 'NUM') SELECT " + ", ".join(f"{v} AS {k.lower()}" for k, v in _P.items()) + ", sum(n) AS n FROM g GROUP BY ALL")
def p7_projections(spark, d):
    f = _forms(spark, d).select("form", "lemma", "cpos", "feat_str", "n")
    f = f.unionByName(f.filter("cpos = 'NUM'").withColumn("form", F.concat("form", F.lit("_")))).withColumn("m", F.struct("form", "lemma", "cpos", F.col("cpos").alias("pos"), "feat_str"))
    return f.groupBy(*(text.projection(k, "m", "UD").alias(k.lower()) for k in _P)).agg(F.sum("n").alias("n"))


@query(FORM_SQL + "SELECT DISTINCT CASE WHEN cpos = 'PROPN' THEN '_' ELSE feat_str END AS stripped, cpos FROM f")
def p11_strip_feats(spark, d):
    return _forms(spark, d).select(text.strip_feats("feat_str", "cpos", "PROPN").alias("stripped"), "cpos").distinct()


@query(FORM_SQL + "SELECT coalesce(nullif(lemma, ''), form) AS word, sum(n) AS n FROM f GROUP BY 1")
def p12_word_key(spark, d):
    return _forms(spark, d).groupBy(text.word_key("form", "lemma", "either").alias("word")).agg(F.sum("n").alias("n"))


# --- dictionaries


@query(DICT_SQL + "SELECT form, count(*) AS n_analyses, string_agg(lemma || '/' || cpos || '/' || feat_str, ' ' ORDER BY lemma || '/' || cpos || '/' || feat_str) AS analyses FROM train GROUP BY form")
def a1_dictionary(spark, d):
    a = _dictionary(_morphs(spark, d)).groupBy("form").agg(F.count("*").alias("n_analyses"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "lemma", "cpos", "feat_str"))), " ").alias("analyses"))
    return a


@query(DICT_SQL + "SELECT cpos, count(*) AS n FROM train GROUP BY cpos ORDER BY n DESC, cpos LIMIT 5")
def a2_top_tags(spark, d):
    return lexicon.top_tags(_dictionary(_morphs(spark, d)))


@query(DICT_SQL + "SELECT cpos, cpos || '|' || feat_str AS msr, count(*) AS n FROM train GROUP BY ALL")
def a3_msr_frequency(spark, d):
    return lexicon.msr_frequency(_dictionary(_morphs(spark, d)))


_MSR = """, top AS (SELECT cpos, count(*) AS n FROM train GROUP BY cpos ORDER BY n DESC, cpos LIMIT 5),
msr AS (SELECT cpos, cpos || '|' || feat_str AS msr, count(*) AS n FROM train WHERE cpos IN (SELECT cpos FROM top) GROUP BY ALL),
few AS (SELECT cpos || '|' || msr AS oov_msr, n, 0 AS pad FROM msr ORDER BY n DESC, oov_msr LIMIT 10),
oov AS (SELECT CAST(row_number() OVER (ORDER BY pad, n DESC, oov_msr) AS INTEGER) AS rank, oov_msr FROM (SELECT * FROM few UNION ALL SELECT cpos || '|' || cpos || '|', n, 1 FROM top) QUALIFY rank <= 10)"""


@query(DICT_SQL.rstrip() + _MSR + " SELECT rank, oov_msr FROM oov")
def a4_oov_msrs(spark, d):
    return lexicon.oov_msrs(_dictionary(_morphs(spark, d)))


@query(DICT_SQL.rstrip() + _MSR + " SELECT cpos, CAST(row_number() OVER (PARTITION BY cpos ORDER BY n DESC, msr) AS INTEGER) AS rank, cpos || '|' || msr AS oov_msr FROM msr QUALIFY rank <= 5")
def a4_oov_msrs_per_tag(spark, d):
    return lexicon.oov_msrs_per_tag(_dictionary(_morphs(spark, d)))


@query(DICT_SQL + "SELECT lang, count(*) AS n_tokens, count(*) FILTER (WHERE form NOT IN (SELECT form FROM train)) AS n_oov, count(DISTINCT form) AS n_forms, count(DISTINCT form) FILTER (WHERE form NOT IN (SELECT form FROM train)) AS n_oov_forms FROM test GROUP BY lang")
def a5_analysis_stats(spark, d):
    m = _morphs(spark, d)
    return lexicon.analysis_stats(m, _dictionary(m), ["lang"])


@query(f"WITH {EDGES_SQL}, s AS (SELECT doc_id, line_no, count(DISTINCT tok_no) AS t, count(*) AS m FROM edge GROUP BY ALL) SELECT doc_id % 10 AS part, count(*) AS n_sentences, sum(t) AS n_tokens, sum(m) AS n_morphs, round(sum(m) / sum(t), 6) AS morphs_per_token FROM s GROUP BY 1")
def a6_ambiguity(spark, d):
    return lexicon.ambiguity(_edges(spark, d).withColumn("part", F.col("doc_id") % 10), SENT, ["part"])


@query(f"WITH {TOKENS_SQL}, v AS (SELECT form, min((doc_id, line_no, tok_no)) AS first, count(*) AS n FROM tok GROUP BY form) SELECT form, row_number() OVER (ORDER BY first) - 1 AS id, n FROM v")
def a16_vocabulary(spark, d):
    return lexicon.vocabulary(derived.tokens(_docs(spark, d)), "form", TOKEN)


@query(f"WITH {TOKENS_SQL} SELECT form, count(*) AS n FROM tok GROUP BY form ORDER BY n DESC, form LIMIT 50")
def t1_top_forms(spark, d):
    return ranking.top_n(derived.distinct_forms(derived.tokens(_docs(spark, d))), "n", "form", 50)


@query(DICT_SQL + "SELECT t.doc_id, t.line_no, t.tok_no, t.form, r.cpos AS a_cpos, r.feat_str AS a_feat_str, r.cpos IS NULL AS oov FROM test t LEFT JOIN train r USING (form)")
def j1_lookup(spark, d):
    m = _morphs(spark, d)
    return lexicon.lookup(m.select(*TOKEN, "form"), _dictionary(m)).select(*TOKEN, "form", "a_cpos", "a_feat_str", "oov")


_PREFIXES_SQL = """, tf AS (SELECT DISTINCT form FROM test), px AS (SELECT left(form, l) AS prefix, count(*) AS n FROM (SELECT DISTINCT form FROM train), (VALUES (1), (2), (3)) AS v(l) WHERE l < length(form) GROUP BY 1 ORDER BY n DESC, prefix LIMIT 20),
st AS (SELECT form, left(form, l) AS prefix, substr(form, l + 1) AS host FROM tf, (VALUES (1), (2), (3)) AS v(l) WHERE l < length(form)), cut AS (SELECT form, prefix, host FROM st JOIN px USING (prefix)),
num AS (SELECT form, prefix, host, CASE WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+)?$|^[0-9]{1,3}(,[0-9]{3})*(\\.[0-9]+)?$') THEN 'CD' ELSE 'NCD' END AS cpos FROM cut WHERE regexp_matches(host, '[0-9]') AND host NOT IN (SELECT form FROM train)),
pl AS (SELECT c.form, c.prefix, c.host, t.lemma, t.cpos, t.feat_str FROM cut c JOIN train t ON t.form = c.host UNION ALL SELECT form, prefix, host, '', cpos, '' FROM num)"""


def _prefix_list(dictionary):
    p = dictionary.select("form").distinct().select("form", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("l")).filter("l < length(form)").groupBy(F.expr("left(form, l)").alias("prefix")).agg(F.count("*").alias("n"))
    return p.orderBy(F.desc("n"), "prefix").limit(20).select("prefix")


@query(DICT_SQL.rstrip() + _PREFIXES_SQL + " SELECT form, prefix, host, lemma, cpos, feat_str FROM pl")
def j2_prefix_lookup(spark, d):
    m = _morphs(spark, d)
    dic = _dictionary(m)
    return lexicon.prefix_lookup(m, _prefix_list(dic), dic)


_READ = ", rd AS (SELECT string_split(oov_msr, '|')[1] AS cpos, array_to_string(string_split(oov_msr, '|')[3:], '|') AS feat_str FROM oov)"


@query(DICT_SQL.rstrip() + _MSR + _READ + " SELECT f.form, rd.cpos, rd.feat_str FROM (SELECT DISTINCT form FROM test WHERE form NOT IN (SELECT form FROM train)) f, rd")
def j3_expand_oov(spark, d):
    m = _morphs(spark, d)
    dic = _dictionary(m)
    return lexicon.expand_oov(m, dic, lexicon.oov_msrs(dic))


@query(DICT_SQL.rstrip() + _MSR + _READ + " SELECT f.form, rd.cpos, rd.feat_str FROM (SELECT DISTINCT form FROM test WHERE form IN (SELECT form FROM train WHERE cpos IN (SELECT cpos FROM top))) f, rd")
def j4_dope(spark, d):
    m = _morphs(spark, d)
    dic = _dictionary(m)
    return lexicon.dope(m, dic, lexicon.oov_msrs(dic))


_PROPN = ", hs AS (SELECT form, '' AS prefix, form AS host FROM tf UNION ALL SELECT form, prefix, host FROM cut WHERE length(host) >= 2), pn AS (SELECT form, prefix, host, rd.cpos, rd.feat_str FROM hs, rd)"


@query(DICT_SQL.rstrip() + _MSR + _READ + _PREFIXES_SQL + _PROPN + " SELECT cpos, prefix, feat_str, count(*) AS n, sum(length(host)) AS n_chars FROM pn GROUP BY ALL")
def j5_always_propn(spark, d):
    m = _morphs(spark, d)
    dic = _dictionary(m)
    return lexicon.always_propn(m, _prefix_list(dic), lexicon.oov_msrs(dic)).groupBy("cpos", "prefix", "feat_str").agg(F.count("*").alias("n"), F.sum(F.length("host")).alias("n_chars"))


@query(DICT_SQL.rstrip() + _MSR + _READ + ", an AS (SELECT form, cpos, feat_str, false AS oov FROM train UNION ALL SELECT f.form, rd.cpos, rd.feat_str, true FROM (SELECT DISTINCT form FROM test WHERE form NOT IN (SELECT form FROM train)) f, rd) SELECT doc_id, line_no, tok_no, form, an.cpos, an.feat_str, oov FROM test JOIN an USING (form)")
def g11_analyze_dictionary(spark, d):
    m = _morphs(spark, d)
    dic = _dictionary(m)
    return lexicon.analyze_dictionary(m.select(*TOKEN, "form"), dic, lexicon.oov_msrs(dic)).select(*TOKEN, "form", "cpos", "feat_str", "oov")


_G10 = f""", w AS (SELECT form FROM tf WHERE CASE form {_MARKS} END IS NULL), wh AS (SELECT form, '' AS prefix, form AS host, cpos, feat_str FROM train WHERE form IN (SELECT form FROM w)
    UNION ALL SELECT form, '', form, CASE WHEN regexp_matches(form, '^[0-9]+(\\.[0-9]+)?$|^[0-9]{{1,3}}(,[0-9]{{3}})*(\\.[0-9]+)?$') THEN 'CD' ELSE 'NCD' END, '' FROM w WHERE regexp_matches(form, '[0-9]') AND form NOT IN (SELECT form FROM train)),
fo AS (SELECT * FROM wh UNION ALL SELECT form, prefix, host, cpos, feat_str FROM pl WHERE form IN (SELECT form FROM w)), un AS (SELECT form FROM w WHERE form NOT IN (SELECT form FROM fo)),
ev AS (SELECT form, '' AS prefix, form AS host, CASE form {_MARKS} END AS cpos, '' AS feat_str FROM tf WHERE form NOT IN (SELECT form FROM w) UNION SELECT * FROM fo
    UNION SELECT w.form, '', w.form, rd.cpos, rd.feat_str FROM w, rd WHERE w.form NOT IN (SELECT form FROM wh) UNION SELECT form, prefix, host, cpos, feat_str FROM pn WHERE prefix <> '' AND form IN (SELECT form FROM un))"""


@query(DICT_SQL.rstrip() + _MSR + _READ + _PREFIXES_SQL + _PROPN + _G10 + " SELECT doc_id, count(*) AS n, count(DISTINCT ev.cpos) AS n_tags, sum(length(prefix)) AS in_prefix, count(*) FILTER (WHERE form IN (SELECT form FROM un)) AS n_oov FROM test JOIN ev USING (form) GROUP BY doc_id")
def g10_analyze_lexicon(spark, d):
    m = _morphs(spark, d)
    dic = _once(_dictionary(m))
    a = lexicon.analyze_lexicon(m.select("doc_id", "form"), dic, _prefix_list(dic), lexicon.oov_msrs(dic))
    return a.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("cpos").alias("n_tags"), F.sum(F.length("prefix")).alias("in_prefix"), F.count_if("oov").alias("n_oov"))
