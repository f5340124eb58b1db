"""Comparison of predicted with gold tables. Counts are whole numbers; ratios come from them at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: forms that attachment scores without punctuation leave out.
NO_PUNCT = r"^[,?!:;]$|^-LRB-$|^-RRB-$|^[.]+$|^[`]+$|^[']+$|^（$|^）$|^、$|^。$|^！$|^？$|^…$|^，$|^；$|^／$|^：$|^“$|^”$|^「$|^」$|^『$|^』$|^《$|^》$|^一一$"


def align(a: DataFrame, b: DataFrame, sent: list[str]) -> DataFrame:
    """sent, n_a, n_b, aligned: tokens of each side, null where a side lacks the sentence."""
    count = lambda df, name: df.groupBy(*sent).agg(F.count("*").alias(name))
    return count(a, "n_a").join(count(b, "n_b"), sent, "full_outer").withColumn("aligned", F.coalesce(F.col("n_a") == F.col("n_b"), F.lit(False)))


def match_arcs(pred: DataFrame, gold: DataFrame, sent: list[str]) -> DataFrame:
    """sent, modifier, predicted and gold head and relation, attached, labeled."""
    p = pred.select(*sent, F.col("id").alias("modifier"), F.col("head").alias("p_head"), F.col("deprel").alias("p_deprel"))
    g = gold.select(*sent, F.col("id").alias("modifier"), F.col("head").alias("g_head"), F.col("deprel").alias("g_deprel"))
    both = p.join(g, [*sent, "modifier"], "full_outer")
    attached = F.coalesce(F.col("p_head") == F.col("g_head"), F.lit(False))
    return both.withColumn("attached", attached).withColumn("labeled", attached & F.coalesce(F.col("p_deprel") == F.col("g_deprel"), F.lit(False)))


def sentence_counts(matched: DataFrame, sent: list[str], right: str) -> DataFrame:
    """sent, tp, fp, missed_gold of matched arcs; a gold modifier without a predicted arc counts as a false positive as well."""
    has_p, has_g, ok = F.col("p_head").isNotNull(), F.col("g_head").isNotNull(), F.col(right)
    return matched.groupBy(*sent).agg(F.count_if(ok).alias("tp"), (F.count_if(has_p & ~ok) + F.count_if(has_g & ~has_p)).alias("fp"), F.count_if(has_g & ~ok).alias("missed_gold"))


def summarize(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of counts (tp, fp, missed_gold; one row each sentence): precision, recall, f1, accuracy, exact, population, exact_match.

    A sentence is exact if nothing was predicted wrongly. Ratios without a base are null."""
    total = counts.groupBy(*(by or [])).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("missed_gold").alias("missed_gold"), F.count_if(F.col("fp") == 0).alias("exact"), F.count("*").alias("population"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("missed_gold"))
    ratio = lambda c: F.round(c, 6)
    return total.withColumns({
        "precision": ratio(p), "recall": ratio(r), "f1": ratio(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("missed_gold"))),
        "accuracy": ratio(F.try_divide(F.col("tp") + F.col("missed_gold"), F.col("tp") + F.col("fp") + F.col("missed_gold"))), "exact_match": ratio(F.try_divide("exact", "population")),
    })


def attachment_scores(pred: DataFrame, gold: DataFrame, sent: list[str], by: list[str] | None = None) -> DataFrame:
    """summarize() of unlabeled (uas) and labeled (las) attachment, by metric (A10)."""
    matched = match_arcs(pred, gold, sent)
    both = [sentence_counts(matched, sent, right).withColumn("metric", F.lit(name)) for right, name in (("attached", "uas"), ("labeled", "las"))]
    return summarize(both[0].unionByName(both[1]), [*(by or []), "metric"])


def attachment_scores_nopunct(pred: DataFrame, gold: DataFrame, sent: list[str]) -> DataFrame:
    """n_sentences, n_tokens, head and label accuracy without punctuation, and the rate of sentences with all heads right."""
    g = gold.select(*sent, "id", F.col("head").alias("g_head"), F.col("deprel").alias("g_deprel"))
    rows = pred.join(g, [*sent, "id"]).withColumn("counts", ~F.rlike("form", F.lit(NO_PUNCT)))
    head = F.col("counts") & (F.col("head") == F.col("g_head"))
    per = rows.groupBy(*sent).agg(F.count_if("counts").alias("t"), F.count_if(head).alias("h"), F.count_if(head & (F.col("deprel") == F.col("g_deprel"))).alias("l"))
    total = per.agg(F.count("*").alias("n_sentences"), F.sum("t").alias("n_tokens"), F.sum("h").alias("n_head"), F.sum("l").alias("n_label"), F.count_if(F.col("t") == F.col("h")).alias("n_exact"))
    return total.withColumns({"head_accuracy": F.round(F.try_divide("n_head", "n_tokens"), 6), "label_accuracy": F.round(F.try_divide("n_label", "n_tokens"), 6), "exact_rate": F.round(F.try_divide("n_exact", "n_sentences"), 6)})


def morph_scores(pred: DataFrame, gold: DataFrame, token: list[str], key: Callable[[], Column] | Column) -> DataFrame:
    """token, tp, fp, missed_gold, status: sets of a projection compared token by token; nothing wrong is a Success, also where gold is missed (A9). key is a column of both sides, or a function that gives it."""
    column = key() if callable(key) else key
    p = pred.select(*token, column.alias("k")).distinct().withColumn("p", F.lit(True))
    g = gold.select(*token, column.alias("k")).distinct().withColumn("g", F.lit(True))
    both = p.join(g, [*token, "k"], "full_outer")
    out = both.groupBy(*token).agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull() & F.col("g")).alias("missed_gold"))
    return out.withColumn("status", F.when(F.col("fp") == 0, F.lit("Success")).otherwise(F.lit("Error")))


def morph_scores_within(rows: DataFrame, pred: Column, gold: Column) -> DataFrame:
    """rows of a token each with tp, fp, missed_gold and status, as morph_scores: pred and gold are arrays of keys. No shuffle."""
    rows = rows.withColumns({"_p": F.array_distinct(pred), "_g": F.array_distinct(gold)})
    size = lambda a: F.size(a).cast("long")
    out = rows.withColumns({"tp": size(F.array_intersect("_p", "_g")), "fp": size(F.array_except("_p", "_g")), "missed_gold": size(F.array_except("_g", "_p"))}).drop("_p", "_g")
    return out.withColumn("status", F.when(F.col("fp") == 0, F.lit("Success")).otherwise(F.lit("Error")))


def errors_by_class(scores: DataFrame, cls: str) -> DataFrame:
    """class, n_errors over rows that are not a success."""
    return scores.filter("status = 'Error'").groupBy(F.col(cls).alias("class")).agg(F.count("*").alias("n_errors"))


def number_repeats(rows: DataFrame, sent: list[str], key: list[str], order: list[str]) -> DataFrame:
    """rows with ordinal: 1, 2, ... among the rows of the sentence with the same key."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*sent, *key).orderBy(*order)))


def segment_f1(pred: DataFrame, gold: DataFrame, sent: list[str], order: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """level, gold, pred, tp, precision, recall, f1, em: segments with repeats numbered, at levels of key columns.

    em is the share of sentences whose rows agree in order and in all columns of both sides; it is the same at every level."""
    columns = [c for c in gold.columns if c in pred.columns and c not in sent]
    # one shuffle: equal rows of a sentence are counted on both sides, and all levels and em follow from these counts
    side = lambda df, p: df.select(*sent, *columns, F.lit(p).alias("_p"))
    same = side(pred, 1).unionByName(side(gold, 0)).repartition(*sent).groupBy(*sent, *columns).agg(F.sum("_p").alias("np"), F.sum(1 - F.col("_p")).alias("ng"))
    em = same.groupBy(*sent).agg(F.bool_and(F.col("np") == F.col("ng")).alias("ok")).agg(F.round(F.try_divide(F.count_if("ok"), F.count("*")), 6).alias("em"))
    out = None
    for name, key in levels.items():
        both = same.groupBy(*sent, *key).agg(F.sum("np").alias("np"), F.sum("ng").alias("ng"))
        total = both.agg(F.sum("ng").alias("gold"), F.sum("np").alias("pred"), F.sum(F.least("np", "ng")).alias("tp")).withColumn("level", F.lit(name))
        out = total if out is None else out.unionByName(total)
    ratio = lambda x, y: F.round(F.try_divide(x, y), 6)
    tp, n = F.col("tp"), F.col("gold") + F.col("pred")
    return out.crossJoin(F.broadcast(em)).select("level", "gold", "pred", "tp", ratio(tp, F.col("pred")).alias("precision"), ratio(tp, F.col("gold")).alias("recall"), ratio(2 * tp, n).alias("f1"), "em")  # em: one row


def duplicate_audit(rows: DataFrame, sent: list[str], key: list[str]) -> DataFrame:
    """Segments that a sentence has more than once, and how often."""
    return rows.groupBy(*sent, *key).agg(F.count("*").alias("n")).filter("n > 1")


def backoff_match(gold: DataFrame, candidates: DataFrame, token: list[str], keys: list[tuple[str, Column]], oov_tag: str = "NNP") -> DataFrame:
    """The gold path of each token followed through its lattice with back-off (J20): token, morph_idx, level, n_matches, from_node, to_node, form, cpos of the edge taken.

    At the node reached, the first key in order counts by which an edge equals the gold morpheme; of several such edges the last (by end, form, tag) is taken. Where none
    does by any key, a node whose one edge has oov_tag is left by it (level oov); else the level is none and the token is over. gold and candidates are edges; the keys' columns
    are theirs, null ones count as empty."""
    value = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for _, c in keys))
    edge = F.struct(F.col("to_node").cast("bigint").alias("to_node"), F.coalesce("form", F.lit("")).alias("form"), F.coalesce("cpos", F.lit("")).alias("cpos"), F.col("from_node").cast("bigint").alias("from_node"), value.alias("k"))
    side = lambda df, name: df.groupBy(*token).agg(F.array_sort(F.collect_set(edge)).alias(name))
    g = gold.groupBy(*token).agg(F.array_sort(F.collect_list(F.struct("from_node", "to_node", value.alias("k")))).alias("g"))
    rows = g.join(side(candidates, "c"), token)
    return steps(rows.select(*token, _backed_off([n for n, _ in keys], oov_tag).alias("steps")), token)


def steps(rows: DataFrame, token: list[str]) -> DataFrame:
    """The rows of backoff_match, of rows of a token each with its steps in an array."""
    return rows.select(*token, F.explode("steps").alias("w")).select(*token, F.col("w.i").alias("morph_idx"), "w.level", F.col("w.n").alias("n_matches"), "w.from_node", "w.to_node", "w.form", "w.cpos")


def backoff_rows(rows: DataFrame, gold: Column, candidates: Column, keys: list[tuple[str, Callable[[Column], Column]]], oov_tag: str = "NNP") -> DataFrame:
    """rows of a token each with steps, an array that steps() makes the rows of backoff_match of: gold and candidates are arrays of edges (from_node, to_node, form, cpos), keys functions of an edge. No shuffle."""
    value = lambda e: F.array(*(F.coalesce(k(e).cast("string"), F.lit("")) for _, k in keys))
    big = lambda e, c: e[c].cast("bigint").alias(c)
    edge = lambda e: F.struct(big(e, "to_node"), F.coalesce(e["form"], F.lit("")).alias("form"), F.coalesce(e["cpos"], F.lit("")).alias("cpos"), big(e, "from_node"), value(e).alias("k"))
    made = rows.withColumns({
        "c": F.array_sort(F.array_distinct(F.transform(candidates, edge))),
        "g": F.array_sort(F.transform(gold, lambda e: F.struct(e["from_node"].alias("from_node"), e["to_node"].alias("to_node"), value(e).alias("k")))),
    })
    return made.filter("size(g) > 0 and size(c) > 0").withColumn("steps", _backed_off([n for n, _ in keys], oov_tag)).drop("c", "g")


def _backed_off(keys: list[str], oov_tag: str) -> Column:
    """The walk along g through c, both with keys k, as an array of steps."""
    names = ", ".join(f"'{n}'" for n in keys)
    record = "struct<i: int, level: string, n: int, from_node: bigint, to_node: bigint, form: string, cpos: string>"
    level = f"get(filter(sequence(0, {len(keys) - 1}), l -> exists(here, e -> e.k[l] = m.k[l])), 0)"
    took = lambda e, name, n: f"named_struct('at', {e}.to_node, 'i', s.i + 1, 'over', false, 'out', array_append(s.out, named_struct('i', s.i, 'level', {name}, 'n', {n}, 'from_node', s.at, 'to_node', {e}.to_node, 'form', {e}.form, 'cpos', {e}.cpos)))"
    hits = "filter(here, e -> e.k[l] = m.k[l])"
    found = f"transform(array({hits}), h -> {took('element_at(h, -1)', f'array({names})[l]', 'size(h)')})[0]"
    alone = f"if(size(here) = 1 and here[0].cpos = '{oov_tag}', {took('here[0]', chr(39) + 'oov' + chr(39), '0')}, named_struct('at', s.at, 'i', s.i + 1, 'over', true, 'out', array_append(s.out, named_struct('i', s.i, 'level', 'none', 'n', 0, 'from_node', s.at, 'to_node', cast(null as bigint), 'form', cast(null as string), 'cpos', cast(null as string)))))"
    step = f"transform(array(filter(c, e -> e.from_node = s.at)), here -> transform(array({level}), l -> if(l is not null, {found}, {alone}))[0])[0]"
    start = f"named_struct('at', array_min(transform(c, e -> e.from_node)), 'i', 0, 'over', false, 'out', cast(array() as array<{record}>))"
    return F.expr(f"aggregate(g, {start}, (s, m) -> if(s.over, s, {step}), s -> s.out)")
