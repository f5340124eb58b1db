"""URL filters: sort-merge range join of URLs with nested prefix rules, in DataFrame operations only.

Canonical keys: a host with its labels reversed, each followed by a dot (com.example.blog.), so all
hosts under a rule's host are the keys that begin with the rule's key: an interval. Intervals of
prefixes nest or are disjoint. In key order a sweep keeps the stack of the rules that are open; a
rule's own stack is known from the rules alone (its prefixes among them), so what a point needs is
the stack at the last opening or closing before it: last(..., ignore nulls) over the sorted keys.

The sweep is cut into ranges of keys: a range begins with the stack that is open where the one
before it ends. It is used twice: over distinct hosts with the rules' hosts, then over (rule host,
path) with the rules' paths, which gives the deepest fitting path rule of each rule host. Distinct
points are swept, so a host that holds a third of all pages is one row; the joins back split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import Scratch

#: The rules of the query, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The verdict where no rule fits.
DEFAULT = "allow"
_END = "\U0010ffff"  # sorts after what follows a prefix (it is no character, so no URL has it)
_BAR = "\x01"  # between a rule's host and a path


def host_key(host: Column) -> Column:
    """com.example.blog. for blog.example.com"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """points (key) and prefixes (key) -> key and stack: the prefixes of each distinct key, shortest first; only where there are any.

    The prefixes' own stacks come from a join of all their beginnings with them."""
    known = prefixes.select("key").distinct()
    begin = known.select("key", F.explode(F.expr("transform(sequence(1, char_length(key)), i -> left(key, i))")).alias("part"))
    nested = begin.join(known.withColumnRenamed("key", "part"), "part").groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("stack"))
    opening = nested.select("key", F.lit(0).alias("turn"), "stack")
    closing = nested.select(F.concat("key", F.lit(_END)).alias("key"), F.lit(0).alias("turn"), F.slice("stack", 1, F.size("stack") - 1).alias("stack"))
    events = points.select("key").distinct().select("key", F.lit(1).alias("turn"), F.lit(None).cast("array<string>").alias("stack")).unionByName(opening).unionByName(closing)
    events = scratch.save(events.repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    # the stack at the end of each range, for those after it; one row for each range
    ends = events.groupBy("range").agg(F.max_by("stack", F.when(F.col("turn") == 0, F.col("key"))).alias("stack"))
    carried = ends.select("range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("stack"))
    events = events.unionByName(carried.filter("stack is not null").select(F.lit("").alias("key"), F.lit(-1).alias("turn"), "stack", "range"))
    order = Window.partitionBy("range").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("turn = 1 and size(stack) > 0").select("key", "stack")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (between the first :// and the next /, ? or #; A-Z lower-cased) and path (up to ? or #); without :// both are empty."""
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.char_length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table of literals."""
    each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*each)).alias("r")).select("r.*")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages (url, more) and rules (host, path, verdict) -> the columns of pages with host, path, rule and verdict.

    A rule fits its host and all subdomains where the path begins with its path. The longest rule (host and path
    together) wins, of equal ones the longer host, then the greater rule and verdict. Null urls and those without ://
    have empty host and path and get the default, as all do that no rule fits; so do those whose rule has a null verdict (the rule is still
    named). Columns of those four names are replaced; repeated rows stay; an empty table gives an empty result."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url").cast("string"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rules = rules.select("path", "verdict", F.concat("host", "path").alias("rule"), F.char_length("host").alias("of"), host_key(F.col("host")).alias("rule_host")).filter("rule is not null")
    rules = rules.groupBy("rule_host", "path").agg(F.max(F.struct(F.char_length("rule").alias("long"), "of", "rule", "verdict")).alias("rule"))
    longest = rules.agg(F.max(F.char_length("path"))).first()[0] or 0
    pages = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("_begin", F.left("path", F.lit(longest)))
    asked = scratch.save(pages.groupBy("host", "_begin").agg(F.count("*").alias("n")).select(host_key(F.col("host")).alias("key"), "host", "_begin"))

    over_hosts = sweep(asked, rules.select(F.col("rule_host").alias("key")), scratch)
    open_rules = asked.join(over_hosts, "key").select("host", "_begin", F.explode("stack").alias("rule_host"))
    path_key = lambda path: F.concat("rule_host", F.lit(_BAR), path)
    open_rules = scratch.save(open_rules.withColumn("key", path_key(F.col("_begin"))))
    rules = rules.withColumn("deepest", path_key(F.col("path"))).select("deepest", "rule")
    over_paths = sweep(open_rules, rules.select(F.col("deepest").alias("key")), scratch).select("key", F.element_at("stack", -1).alias("deepest"))
    won = open_rules.join(over_paths, "key").join(rules, "deepest").groupBy("host", "_begin").agg(F.max("rule").alias("won"))
    judged = pages.join(won, ["host", "_begin"], "left")
    return judged.select(*kept, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def oracle() -> str:
    """The same for the query's rules in DuckDB SQL."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
    r(h, p, v) AS (VALUES {rules}),
    f AS (SELECT page_id, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS verdict
        FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM s LEFT JOIN f USING (page_id)"""
