"""Chat formatting: cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often hold a conversation several times, as it grew. The hash of each turn's prefix (all
turns up to it) is a running exclusive-or of turn hashes that include the turn's place: two 64-bit
ones with different seeds. A conversation whose last prefix hash is an inner prefix hash of another
is a snapshot that a longer one contains; an anti-join leaves the maximal conversations, of equal
ones that of the least conv_id, and these are rendered.

Prefix hashes carry no text, and are made distinct before the anti-join, so a first turn that very
many conversations share is one row for each task. A conversation's turns are numbered in chunks, so
one with very many turns is spread over tasks until it is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns are numbered in chunks of so many values of `turn`.
CHUNK = 4096


def _said() -> tuple[Column, Column]:
    return F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text, which also order turns of one number and role."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), F.reverse(text), text).alias("t2")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, place (from 1), n, p1, p2: each turn's prefix hashes, and the conversation's length.

    Turns follow their number, null first, then role and text; repeats of a row count once. A null role is `unknown` and a null text empty."""
    role, text = _said()
    rows = turns.select("conv_id", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK).alias("chunk"), "turn", role.alias("role"), *_hashes(text)).filter("conv_id is not null").distinct()
    inner = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "t1", "t2")
    rows = rows.withColumn("at", F.row_number().over(inner))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("size"))
    of = Window.partitionBy("conv_id")
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(of.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("size").over(of))
    rows = rows.join(sizes.drop("size"), ["conv_id", "chunk"]).withColumn("place", F.col("before") + F.col("at"))
    rows = rows.withColumn("h1", F.xxhash64("place", "role", "t1", "t2")).withColumn("h2", F.xxhash64(F.lit(11), "t2", "t1", "role", "place"))
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "chunk", "place", "n", F.expr("bit_xor(h1)").over(upto).alias("x1"), F.expr("bit_xor(h2)").over(upto).alias("x2"), "h1", "h2")
    chunks = rows.groupBy("conv_id", "chunk").agg(F.expr("bit_xor(h1)").alias("c1"), F.expr("bit_xor(h2)").alias("c2"))
    prior = of.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "chunk", F.coalesce(F.expr("bit_xor(c1)").over(prior), F.lit(0)).alias("c1"), F.coalesce(F.expr("bit_xor(c2)").over(prior), F.lit(0)).alias("c2"))
    return rows.join(chunks, ["conv_id", "chunk"]).select("conv_id", "place", "n", F.expr("x1 ^ c1").alias("p1"), F.expr("x2 ^ c2").alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """turns -> conv_id, n_turns, n_copies for the conversations that are no prefix of a longer one; equal ones count as copies of the least."""
    each = prefixes(turns)
    whole = each.filter("place = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = each.filter("place < n").select(F.col("place").alias("n"), "p1", "p2").distinct()
    return whole.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, more) -> conv_id, n_turns, n_copies, chat: one row for each maximal conversation.

    A turn is <|role|>, a line break, its text and <|end|>, a line break; null roles are `unknown`, null texts empty, also
    where conversations are compared. Rows without a conv_id are left out; repeats of a row count once; other columns are not used. An empty
    table gives an empty result."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = maximal(turns)
    role, text = _said()
    said = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))
    order = F.struct("turn", role.alias("role"), *_hashes(text), said.alias("said"))
    # repeats go where a conversation is put together: its text is shuffled once
    chats = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.array_distinct(F.collect_list(order))).alias("all"))
    return chats.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("all", lambda t: t["said"]), "").alias("chat"))


def oracle() -> str:
    """The same in DuckDB SQL, for tables whose turns are distinct numbers."""
    return """
    WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role) AS said, count(*) AS n_turns FROM t GROUP BY conv_id),
    p AS (SELECT conv_id, n_turns, sha256(said::VARCHAR) AS whole, said FROM c),
    w AS (SELECT whole, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p GROUP BY whole, n_turns),
    i AS (SELECT DISTINCT sha256(said[1:k]::VARCHAR) AS inner_hash FROM (SELECT said, n_turns, unnest(range(1, n_turns)) AS k FROM p)),
    m AS (SELECT * FROM w WHERE whole NOT IN (SELECT inner_hash FROM i))
    SELECT m.conv_id, CAST(m.n_turns AS BIGINT) AS n_turns, m.n_copies,
        list_aggregate(list_transform(p.said, lambda s: '<|' || s.r || '|>' || chr(10) || s.x || '<|end|>' || chr(10)), 'string_agg', '') AS chat
    FROM m JOIN p USING (conv_id)"""
