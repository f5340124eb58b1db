"""An annotated corpus derived from the documents table by fixed rules, with the same rules in SQL.

A sentence is a line of a document that has a token; a token is a maximal run of characters other
than space and tab..CR. Tags, lemmas and features follow from the form. A token's candidate
analyses are the whole token and, where a common prefix of 1 to 3 characters is followed by a known
form, prefix and host. The gold analysis is the split with the longest prefix, if there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WORD

SENT = ["doc_id", "line_no"]
N_PREFIXES = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokens(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, lang, line_no, tok_no (both from 1), form. No shuffle."""
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", "lang", (F.col("line_no") + 1).alias("line_no"), F.posexplode(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("tok_no", "form"))
    return words.withColumn("tok_no", F.col("tok_no") + 1)


TOKENS_SQL = """
line AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
sent AS (SELECT doc_id, lang, line_no, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS forms FROM line),
tok AS MATERIALIZED (SELECT doc_id, lang, CAST(line_no AS INTEGER) AS line_no, CAST(generate_subscripts(forms, 1) AS INTEGER) AS tok_no, unnest(forms) AS form FROM sent)"""


def cpos(form: Column) -> Column:
    return F.when(F.rlike(form, F.lit("[0-9]")), F.lit("NUM")).when(~F.rlike(form, F.lit(r"\p{L}")), F.lit("PUNCT")).when(F.rlike(form, F.lit(r"^\p{Lu}")), F.lit("PROPN")).otherwise(F.lit("X"))


def lemma(form: Column) -> Column:
    return F.regexp_replace(F.lower(form), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def feat_str(form: Column, lang: Column) -> Column:
    """gen and num by the form's length, Lang, and for longer forms two suf_gen, out of order."""
    n = F.length(form)
    tail = F.when(n > 8, F.lit("|suf_gen=F|suf_gen=M")).otherwise(F.lit(""))
    return F.concat(F.lit("Lang="), F.coalesce(lang, F.lit("xx")), F.lit("|gen="), F.when(n % 2 == 1, F.lit("F")).otherwise(F.lit("M")), F.lit("|num="), F.when(F.endswith(form, F.lit("s")), F.lit("P")).otherwise(F.lit("S")), tail)


def morphs(docs: DataFrame) -> DataFrame:
    """tokens with cpos, lemma and feat_str."""
    return tokens(docs).select("*", cpos(F.col("form")).alias("cpos"), lemma(F.col("form")).alias("lemma"), feat_str(F.col("form"), F.col("lang")).alias("feat_str"))


MORPHS_SQL = (
    TOKENS_SQL
    + r""",
morph AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(form, '[0-9]') THEN 'NUM' WHEN NOT regexp_matches(form, '\p{L}') THEN 'PUNCT' WHEN regexp_matches(form, '^\p{Lu}') THEN 'PROPN' ELSE 'X' END AS cpos,
    regexp_replace(lower(form), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS lemma,
    'Lang=' || coalesce(lang, 'xx') || '|gen=' || CASE WHEN length(form) % 2 = 1 THEN 'F' ELSE 'M' END || '|num=' || CASE WHEN ends_with(form, 's') THEN 'P' ELSE 'S' END
        || CASE WHEN length(form) > 8 THEN '|suf_gen=F|suf_gen=M' ELSE '' END AS feat_str FROM tok)"""
)


def common_prefixes(forms: DataFrame) -> DataFrame:
    """forms (form, n) -> prefix, len: the N_PREFIXES commonest first 1 to 3 characters of forms, by count of tokens, then prefix."""
    starts = forms.select("n", "form", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("len")).filter("len < length(form)")
    return starts.groupBy(F.expr("left(form, len)").alias("prefix"), "len").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "prefix").limit(N_PREFIXES).select("prefix", "len")


def splits(forms: DataFrame, *more: str) -> DataFrame:
    """forms (form, n, more) -> form, prefix, host, more: each common prefix that is followed by a known form. The prefixes are N_PREFIXES rows and are broadcast."""
    known = forms.select(F.col("form").alias("host"))
    cut = forms.select("form", *more, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("len")).filter("len < length(form)").select(F.expr("left(form, len)").alias("prefix"), F.expr("substring(form, len + 1)").alias("host"), *more)
    return cut.join(F.broadcast(common_prefixes(forms).select("prefix")), "prefix").join(known, "host").select(F.concat("prefix", "host").alias("form"), "prefix", "host", *more)


def split_numbers(forms: DataFrame) -> DataFrame:
    """Rows of slice_forms -> token, slices, value (numbers of its paths in order, 0 for the whole token first) of forms that have more than one path."""
    found = splits(forms, "slices").groupBy(F.col("form").alias("token")).agg(F.first("slices").alias("slices"), F.array_sort(F.collect_list(F.length("prefix"))).alias("at"))
    return found.select("token", "slices", F.array_prepend("at", F.lit(0)).alias("value"))


def paths_of(form: Column, at: Column) -> Column:
    """The paths of a form (path, parts) by their numbers, null if it has that of the whole token alone."""
    part = lambda a, b, piece, tag: F.struct(F.lit(a).alias("from_node"), F.lit(b).alias("to_node"), piece.alias("piece"), tag.alias("cpos"))
    whole = F.array(part(0, 2, form, cpos(form)))

    def path(k: Column) -> Column:
        host = F.substr(form, k + 1)
        return F.struct(k.alias("path"), F.when(k == 0, whole).otherwise(F.array(part(0, 1, F.left(form, k), F.lit("PREFIX")), part(1, 2, host, cpos(host)))).alias("parts"))

    return F.when(at.isNull(), F.array(F.struct(F.lit(0).alias("path"), whole.alias("parts")))).otherwise(F.transform(at, path))


def edges_within(paths: Column, more: Callable[[Column], list[Column]] = lambda m: []) -> Column:
    """The edges of a token's paths in an array: path, from_node, to_node, form, cpos and more, made of an edge with the fields piece and cpos."""
    edge = lambda p, m: F.struct(p["path"].alias("path"), m["from_node"].alias("from_node"), m["to_node"].alias("to_node"), m["piece"].alias("form"), m["cpos"].alias("cpos"), *more(m))
    first = paths[0]
    return F.when((F.size(paths) == 1) & (F.size(first["parts"]) == 1), F.array(edge(first, first["parts"][0]))).otherwise(F.flatten(F.transform(paths, lambda p: F.transform(p["parts"], lambda m: edge(p, m)))))


def distinct_forms(toks: DataFrame) -> DataFrame:
    return toks.groupBy("form").agg(F.count("*").alias("n"))


#: Documents of a slice, by their ids. What is found for a form comes to its tokens once for each slice that has the form.
SLICE = 2048


def slice_of() -> Column:
    return F.expr(f"coalesce(doc_id div {SLICE}, 0)").alias("slice")


def slice_forms(docs: DataFrame) -> DataFrame:
    """documents -> form, n, slices: distinct forms with how many tokens have them, and the slices of documents that do."""
    words = docs.select(slice_of(), F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("form"))
    return words.groupBy("form", "slice").agg(F.count("*").alias("n")).groupBy("form").agg(F.sum("n").alias("n"), F.collect_list("slice").alias("slices"))


def slice_readings(docs: DataFrame) -> DataFrame:
    """documents -> form, slices, langs: distinct forms, the slices that have them, and the languages in which documents to learn from (doc_id % 10 <> 0) have them."""
    words = docs.select(slice_of(), F.when(F.col("doc_id") % 10 != 0, F.coalesce("lang", F.lit("xx"))).alias("lang"), F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("form"))
    return words.distinct().groupBy("form").agg(F.collect_set("slice").alias("slices"), F.collect_set("lang").alias("langs"))


def readings(forms: DataFrame) -> DataFrame:
    """Rows of slice_readings -> form, lemma, cpos, feat_str: the dictionary of the documents to learn from, each analysis once. No shuffle."""
    form = F.col("form")
    return forms.select("form", F.explode("langs").alias("lang")).select("form", lemma(form).alias("lemma"), cpos(form).alias("cpos"), feat_str(form, F.col("lang")).alias("feat_str"))


def slice_tokens(docs: DataFrame, values: DataFrame, ranged: bool = False) -> DataFrame:
    """documents and values (slices, token, value) -> slice, doc_id, line_no, tok_no, token, value (null where the form has none), a row for each token.

    ranged: slices come in ranges of their order. Texts are shuffled as they are, by slice, with each value once for each slice. Later steps by slice and other columns need no more shuffle."""
    nothing = lambda kind: F.lit(None).cast(kind)
    kind = values.schema["value"].dataType
    texts = docs.filter("text is not null").select(slice_of(), "doc_id", "text", nothing("string").alias("token"), nothing(kind).alias("value"))
    given = values.select(F.explode("slices").alias("slice"), nothing(docs.schema["doc_id"].dataType).alias("doc_id"), nothing("string").alias("text"), "token", "value")
    both = texts.unionByName(given)
    both = both.repartitionByRange("slice") if ranged else both.repartition("slice")
    # a row that has no text but a value stays one row, without a line
    lines = both.select("slice", "doc_id", "token", "value", F.posexplode(F.coalesce(F.split("text", "\n"), F.array(F.lit("-")))).alias("line_no", "line"))
    words = lines.select("slice", "doc_id", F.col("token").alias("of"), "value", (F.col("line_no") + 1).alias("line_no"), F.posexplode(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("tok_no", "form"))
    words = words.select("slice", "doc_id", F.when(F.col("of").isNull(), F.col("line_no")).alias("line_no"), (F.col("tok_no") + 1).alias("tok_no"), F.coalesce("of", "form").alias("token"), "value")
    found = F.first("value", True).over(Window.partitionBy("slice", "token").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return words.withColumn("value", found).filter("line_no is not null")


def form_paths(forms: DataFrame, *more: str) -> DataFrame:
    """forms (form, n, more) -> token, more, paths: one row a form, with its candidate paths (path, parts) by path (0: the whole token, k: prefix of k characters)."""
    whole = forms.select("form", *more, F.lit(0).alias("path"))
    both = whole.unionByName(splits(forms).select("form", F.length("prefix").alias("path")), allowMissingColumns=True)
    found = both.groupBy("form").agg(*(F.first(c, True).alias(c) for c in more), F.array_sort(F.collect_list("path")).alias("at"))
    return found.select(F.col("form").alias("token"), *more, paths_of(F.col("form"), F.col("at")).alias("paths"))


def edges_of(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of form_paths, with more columns key -> edges: key, token, path, from_node, to_node, form, cpos."""
    found = rows.select(*key, "token", F.explode("paths").alias("p")).select(*key, "token", "p.path", F.explode("p.parts").alias("m"))
    return found.select(*key, "token", "path", "m.from_node", "m.to_node", F.col("m.piece").alias("form"), "m.cpos")


def edges(toks: DataFrame) -> DataFrame:
    """tokens -> candidate edges: doc_id, line_no, tok_no, edge_id, from_node, to_node, form, cpos, path (0: the whole token, k: prefix of k characters).

    Distinct forms are analysed once and joined back."""
    found = toks.select(*SENT, "tok_no", F.col("form").alias("token")).join(form_paths(distinct_forms(toks)), "token")
    return edges_of(found, *SENT, "tok_no")


EDGES_SQL = (
    MORPHS_SQL
    + f""",
forms AS MATERIALIZED (SELECT form, count(*) AS n FROM tok GROUP BY form),
pre AS (SELECT left(form, l) AS prefix, l AS len, sum(n) AS n FROM forms, (VALUES (1), (2), (3)) AS v(l) WHERE l < length(form) GROUP BY 1, 2 ORDER BY n DESC, prefix LIMIT {N_PREFIXES}),
split AS MATERIALIZED (SELECT f.form, p.prefix, p.len, h.form AS host FROM forms f JOIN pre p ON p.len < length(f.form) AND left(f.form, p.len) = p.prefix JOIN forms h ON h.form = substr(f.form, p.len + 1)),
cp AS (SELECT DISTINCT form, cpos FROM morph),
edge AS MATERIALIZED (
    SELECT doc_id, line_no, tok_no, form AS token, 0 AS path, 0 AS from_node, 2 AS to_node, form, cpos FROM morph
    UNION ALL SELECT doc_id, line_no, tok_no, t.form, len, 0, 1, prefix, 'PREFIX' FROM tok t JOIN split USING (form)
    UNION ALL SELECT doc_id, line_no, tok_no, t.form, len, 1, 2, host, cp.cpos FROM tok t JOIN split USING (form) JOIN cp ON cp.form = host)"""
)


DEEP = 5


def deep_edges(toks: DataFrame, key: list[str] = [*SENT, "tok_no"]) -> DataFrame:  # noqa: B006
    """tokens (key with tok_no, form) -> lattices of up to DEEP edges in a row: key, token, from_node, to_node, form, cpos. A form is cut into DEEP pieces (as many
    as it has characters, if fewer); an edge is a piece (M1) or, from nodes that are even or odd as the token's number is, two (M2). No shuffle."""
    return deep_lattices(toks, key).select(*key, "token", F.explode("edges").alias("e")).select(*key, "token", "e.*")


def deep_lattices(toks: DataFrame, key: list[str]) -> DataFrame:
    """deep_edges with a token's edges in the array edges, one row a token."""
    k, n = f"least({DEEP}, length(form))", "length(form)"
    place = lambda i: f"(({i}) * {n} div {k})"
    piece = lambda w: f"struct(i as from_node, i + {w} as to_node, substring(form, cast({place('i')} as int) + 1, cast({place(f'i + {w}')} - {place('i')} as int)) as form, 'M{w}' as cpos)"
    made = f"flatten(transform(sequence(0, {k} - 1), i -> if((i + tok_no) % 2 = 0 and i + 2 <= {k}, array({piece(1)}, {piece(2)}), array({piece(1)}))))"
    return toks.select(*key, F.col("form").alias("token"), F.expr(made).alias("edges"))


# the lattice of a token follows from its form and whether its number is even: they are made once for each such pair
DEEP_SQL = (
    TOKENS_SQL
    + f""",
dl AS MATERIALIZED (SELECT form AS token, tok_no % 2 AS odd, count(*) AS n, least({DEEP}, length(form)) AS k FROM tok GROUP BY ALL),
de AS MATERIALIZED (SELECT token, odd, k, i AS a, i + w AS b, substr(token, (i * length(token)) // k + 1, ((i + w) * length(token)) // k - (i * length(token)) // k) AS form, 'M' || w AS cpos
    FROM (SELECT *, unnest(range(k)) AS i FROM dl), (VALUES (1), (2)) AS v(w) WHERE i + w <= k AND (w = 1 OR (i + odd) % 2 = 0))"""
)


def sentences(docs: DataFrame, ranged: bool = False, langs: bool = False) -> DataFrame:
    """documents -> doc_id, line_no, arcs: one row a sentence, with its tokens (id, form, cpos) in order. Lines are shuffled as they are, before their tokens are made.

    ranged: sentences come in ranges of their order and in order within them, as files want them. langs: tokens have the document's language, lang, as well."""
    more = ["lang"] if langs else []
    lines = docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", *more, (F.col("line_no") + 1).alias("line_no"), "line").filter(F.rlike("line", F.lit(WORD)))
    found = (lines.repartitionByRange(*SENT) if ranged else lines).groupBy(*SENT).agg(F.collect_list(F.struct("line", *more) if langs else "line").alias("lines"))
    found = found.sortWithinPartitions(*SENT) if ranged else found
    words = lambda x: F.transform(F.regexp_extract_all(x["line"] if langs else x, F.lit(WORD), F.lit(0)), lambda w, i: F.struct((i + 1).alias("id"), w.alias("form"), cpos(w).alias("cpos"), *(x[c].alias(c) for c in more)))
    # lines of documents with one doc_id are one sentence
    return found.select(*SENT, F.when(F.size("lines") == 1, words(F.col("lines")[0])).otherwise(F.array_sort(F.flatten(F.transform("lines", words)))).alias("arcs"))


def sentence_arcs(docs: DataFrame, ranged: bool = False) -> DataFrame:
    """The gold trees of arcs, one row a sentence: doc_id, line_no, arcs (array of id, form, cpos, head, deprel)."""
    arc = lambda t: F.struct(t["id"].alias("id"), t["form"].alias("form"), t["cpos"].alias("cpos"), F.floor(t["id"] / 2).cast("int").alias("head"), t["cpos"].alias("deprel"))
    return sentences(docs, ranged).withColumn("arcs", F.transform("arcs", arc))


def arcs(docs: DataFrame, predicted: bool = False) -> DataFrame:
    """Trees by rule: doc_id, line_no, id, form, cpos, head, deprel. A token's head is half its number, rounded down (the first is the root, head 0); the
    relation is its tag. Predicted trees differ at every fifth token (head) and every seventh (relation dep)."""
    m = morphs(docs).select(*SENT, F.col("tok_no").alias("id"), "form", "cpos", F.floor(F.col("tok_no") / 2).cast("int").alias("head"), F.col("cpos").alias("deprel"))
    if predicted:
        m = m.withColumn("head", F.when(F.col("id") % 5 == 0, F.col("id") - 1).otherwise(F.col("head"))).withColumn("deprel", F.when(F.col("id") % 7 == 0, F.lit("dep")).otherwise(F.col("deprel")))
    return m


ARCS_SQL = (
    MORPHS_SQL
    + """,
gold AS (SELECT doc_id, line_no, tok_no AS id, form, cpos, tok_no // 2 AS head, cpos AS deprel FROM morph),
pred AS (SELECT doc_id, line_no, id, form, cpos, CASE WHEN id % 5 = 0 THEN id - 1 ELSE head END AS head, CASE WHEN id % 7 = 0 THEN 'dep' ELSE deprel END AS deprel FROM gold)"""
)
