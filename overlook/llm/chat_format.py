"""Chat formatting after a cumulative-snapshot collapse.

Logged conversations often hold every earlier state of a longer one. Each conversation's turns are hashed
into a chain, prefix by prefix; a conversation whose last hash occurs among the proper prefixes of
another, or ends a conversation of a smaller id, goes by anti-join; those that stay, the maximal ones,
are rendered one block a turn.

A turn's hash is 120 bits of SHA-256 over its place, role and text; a prefix's hash is the
running exclusive or of its turns' hashes, beside its length: a window, linear in the turns. Hashes travel
alone: texts are sent once, to gather a conversation's turns.

Edge cases: turns go by (turn, role, text), nulls first; rows that repeat all of these count once; a null
role is `unknown`, a null text empty; rows without a conv_id are dropped; roles and texts are rendered as
they stand but for the template's own marks, which are broken up; a single turn is a conversation;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, marks): turns in order, and a hash (a, b) of each turn with its place."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    held = held.withColumn("turns", F.expr("filter(turns, (x, i) -> i = 0 or not (x <=> turns[i - 1]))"))  # in order, so repeats lie side by side
    # lengths keep role and text apart
    digests = "transform(turns, (x, i) -> sha2(concat(i, ':', length(x.role), ':', x.role, x.text), 256))"
    half = lambda at: f"cast(conv(substring(h, {at}, 15), 16, 10) as bigint)"
    return held.withColumn("marks", F.expr(f"transform({digests}, h -> struct({half(1)} as a, {half(17)} as b))"))


def prefixes(held: DataFrame) -> DataFrame:
    """(conv_id, n, k, a, b): the hash of each conversation's first k of n turns."""
    each = held.select("conv_id", F.size("marks").alias("n"), F.posexplode("marks").alias("at", "m")).select("conv_id", "n", (F.col("at") + 1).alias("k"), "m.a", "m.b")
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("conv_id", "n", "k", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations that are no prefix of another; of equal ones that of the smallest conv_id."""
    held = materialize(conversations(turns), "conversations")
    chain = prefixes(held.select("conv_id", "marks"))
    inner = chain.where("k < n").select("k", "a", "b").distinct()
    first = chain.where("k = n").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    stay = first.join(inner, ["k", "a", "b"], "left_anti").select("conv_id")
    return held.select("conv_id", "turns").join(stay, "conv_id", "left_semi")


def render(held: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered."""
    safe = lambda c: f"replace(replace({c}, '{OPEN}', '<| im_start |>'), '{CLOSE}', '<| im_end |>')"
    block = f"concat('{OPEN}', {safe('x.role')}, '\\n', {safe('x.text')}, '{CLOSE}\\n')"
    return held.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.expr(f"array_join(transform(turns, x -> {block}), '')").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    return render(maximal(turns))


def query(spark, sf_dir: str) -> DataFrame:
    out = format_chats(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("long").alias("n_chars"))


ORACLE = f"""
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t
), c AS (
    SELECT conv_id, count(*) AS n_turns, list(length(role) || ':' || role || text ORDER BY k) AS turns,
        string_agg('{OPEN}' || replace(replace(role, '{OPEN}', '<| im_start |>'), '{CLOSE}', '<| im_end |>') || chr(10)
            || replace(replace(text, '{OPEN}', '<| im_start |>'), '{CLOSE}', '<| im_end |>') || '{CLOSE}' || chr(10), '' ORDER BY k) AS rendered
    FROM n GROUP BY conv_id
), p AS (
    SELECT DISTINCT c.turns[1:i.k] AS turns FROM c, (SELECT DISTINCT k FROM n) i WHERE i.k < c.n_turns
)
SELECT conv_id, n_turns, sha256(rendered) AS rendered_sha256, length(rendered) AS n_chars
FROM c
WHERE turns NOT IN (SELECT turns FROM p) AND conv_id = (SELECT min(d.conv_id) FROM c d WHERE d.turns = c.turns)
"""
