"""Chat formatting: collapse of cumulative snapshots, then rendering.

Chat logs store a conversation anew after each turn, so most logged conversations are
prefixes of longer ones. Each turn's hash depends on its place; the running exclusive-or of
these hashes is a rolling hash of every prefix. A conversation whose whole hash is the hash of
a proper prefix of another goes (anti-join), and of equal ones the smallest id stays.

DataFrame functions only. A conversation of any length is cut into segments of turns for the
windows and into parts of bounded length for the output, so none meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Turns of a segment of the running hash, and of a rendered part.
SEGMENT, PART = 64, 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols))


def prefixes(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``pos`` (from 1) and the hashes ``h1, h2`` of the prefix that ends there.
    Turns are in order of (turn, role, text), nulls first."""
    rows = turns.withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))).cast("long"))
    inside = Window.partitionBy("conv_id", "seg").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(inside))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "seg").agg(F.count("*").alias("c")).withColumn("skip", F.coalesce(F.sum("c").over(before), F.lit(0))).select("conv_id", "seg", "skip")
    rows = rows.join(counts, ["conv_id", "seg"]).withColumn("pos", F.col("at") + F.col("skip"))
    rows = rows.withColumns({"t1": F.xxhash64("pos", _hash(1, "role", "text")), "t2": F.xxhash64(_hash(2, "text", "role"), "pos")})
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"h1": F.bit_xor("t1").over(upto), "h2": F.bit_xor("t2").over(upto)})
    zero = F.lit(0).cast("long")
    bases = rows.groupBy("conv_id", "seg").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    bases = bases.select("conv_id", "seg", F.coalesce(F.bit_xor("s1").over(before), zero).alias("b1"), F.coalesce(F.bit_xor("s2").over(before), zero).alias("b2"))
    rows = rows.join(bases, ["conv_id", "seg"])
    return rows.select("conv_id", "turn", "role", "text", "pos", F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(rows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that are no proper prefix of another; of equal ones
    that of the smallest id."""
    lengths = rows.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    marked = rows.select("conv_id", "pos", "h1", "h2").join(lengths, "conv_id")
    whole = marked.where("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = marked.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template; marks within it are broken up so that they can't close it."""
    safe = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")) for c in (role, text)]
    return F.concat(F.lit(OPEN), safe[0], F.lit("\n"), safe[1], F.lit(CLOSE + "\n"))


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """Maximal conversations, rendered: ``(conv_id, n_turns, part int, text)``.

    A conversation is one row, or one for each ``part`` turns; the texts of its parts, in
    order, are the whole. Repeated rows count once. A null role or text is a value of its
    own when conversations are compared and renders as nothing; turns with a null number come
    first; rows with a null conversation id belong to no conversation and are left out. An
    empty table gives no rows. Other columns are not read."""
    turns = chats.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = cut(prefixes(turns.where("conv_id is not null").distinct()))  # compared and rendered
    kept = rows.join(maximal(rows), "conv_id")
    pieces = kept.select("conv_id", "n_turns", F.floor((F.col("pos") - 1) / part).cast("int").alias("part"), F.struct("pos", render(F.col("role"), F.col("text")).alias("t")).alias("piece"))
    whole = pieces.groupBy("conv_id", "n_turns", "part").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return whole.select("conv_id", "n_turns", "part", F.array_join(F.col("pieces.t"), "").alias("text"))


#: DuckDB's version: prefixes are compared by the running text of their turns' digests.
SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        md5(string_agg(md5(coalesce(role, chr(1))) || md5(coalesce(text, chr(1))), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
whole AS (SELECT n, h, min(conv_id) AS conv_id FROM r WHERE pos = n GROUP BY n, h),
kept AS (SELECT conv_id, n FROM whole x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.pos < y.n AND y.pos = x.n AND y.h = x.h))
SELECT r.conv_id AS conv_id, r.n::BIGINT AS n_turns, ((pos - 1) // 64)::INT AS part,
  string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM r JOIN kept ON r.conv_id = kept.conv_id GROUP BY 1, 2, 3
"""
