"""Prefix trie of conversations, built level by level.

A conversation is a sequence of turns; a node of depth d is a distinct sequence of d turns. Going down, each level
groups the conversations that are still live by (parent node, next turn), so a node is a row and its name is its least
conversation. Equal conversations are one weighted sequence from the start; a sequence that is alone in its node leaves, and
the chain below is written in one step, so the number of levels is the depth of the last branch, not the longest
conversation. Going up, each level's leaves and savings are added to its parents' by joins of neighbouring levels.

Turns are short rows (their digest and length) in the shared folder, in bands of depth, so a level reads its own depths only.
Each level is a table of its own: nothing is recomputed from the start when an executor is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, drop_cut, shared_dir
from quarry.llm.exchange import fresh_block
from quarry.llm.runs import crc32_sql

#: Turns of a segment within which running counts are taken; ids of a chunk of the list of members.
SEGMENT, CHUNK = 64, 4096
EMPTY = hashlib.sha256().hexdigest()


def _running(rows: DataFrame, key: str, seg: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the running sum of a value within a key, by segment and order: a key of any number of rows is
    summed in segments, so only their totals meet."""
    rows = rows.withColumns({"seg": seg, "value": value})
    inside = Window.partitionBy(key, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "seg").agg(F.sum("value").alias("total"))
    bases = totals.select(key, "seg", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    out = rows.withColumn(name, F.sum("value").over(inside)).join(bases, [key, "seg"])
    return out.withColumn(name, F.col(name) + F.col("base")).drop("seg", "value", "base")


def numbered(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, pos from 1, turn_key binary, points)``: turns in order of (turn, role, text), nulls first, as digests and
    code points of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = chats.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    seg = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))).cast("long")
    placed = _running(rows, "conv_id", seg, [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], F.lit(1).cast("long"), "pos")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")).cast("binary"), 256))
    return placed.select("conv_id", "pos", key.alias("turn_key"), F.length("text").cast("long").alias("points"))


def with_heads(turns: DataFrame, ids: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Rebuilt conversations of ``(conv_id, pos, turn_key, points)``: each begins with the first h turns of its family's
    first conversation (``conv_id - conv_id % family``) instead of its own, h being the id's crc32 modulo ``most``."""
    heads = ids.select("conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    first = turns.where((F.pmod("conv_id", F.lit(family)) == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("first"), "pos", "turn_key", "points")
    head = heads.join(first, "first").where("pos <= h").select("conv_id", "pos", "turn_key", "points")
    size = first.groupBy("first").agg(F.max("pos").alias("size"))  # h is less than ``most``
    shift = heads.join(size, "first", "left").select("conv_id", "h", (F.least("h", F.coalesce("size", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn_key", "points")
    return head.unionByName(own)


def _stream_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's chunks, joined by commas; rows come sorted by group and chunk."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"seq": [now], "ends": [state.hexdigest()]}, pa.schema([("seq", pa.int64()), ("ends", pa.string())]))

    for batch in batches:
        for seq, part in zip(batch.column("seq").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if seq != now:
                if now is not None:
                    yield row()
                now, state = seq, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
    if now is not None:
        yield row()


def sequences(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations as one: ``(seq, weight, size, points, ends)``, named by the least id, ``ends`` the SHA-256 of the
    members' ids; and ``(conv_id, seq)``. Sequences are compared by two sums of hashes of their placed turns."""
    marks = [F.xxhash64(F.lit(seed), "pos", "turn_key") for seed in (1, 2)]
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("size"), F.sum("points").alias("points"), *(F.bit_xor(m).alias(f"h{k}") for k, m in enumerate(marks)))
    whole = ids.join(whole, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("size", "points", "h0", "h1")))
    whole = cut(whole)
    key = ["size", "h0", "h1"]
    named = whole.groupBy(*key).agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight"), F.max("points").alias("points"))
    member = cut(whole.join(named.select(*key, "seq"), key).select("conv_id", "seq"))
    chunks = member.groupBy("seq", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    parts = chunks.select("seq", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("part"))
    ends = parts.repartition("seq").sortWithinPartitions("seq", "chunk").select("seq", "part").mapInArrow(_stream_sha, "seq long, ends string")
    out = cut(named.join(ends, "seq").select("seq", "weight", "size", "points", "ends"))
    drop_cut(whole)
    return out, member


def _banded(turns: DataFrame):
    """Store the turns in bands of depth, 1, 2 to 3, 4 to 7 and so on, and give a reader of one depth."""
    spark = turns.sparkSession
    path = f"{shared_dir(spark)}/turns-{fresh_block():x}"
    band = F.floor(F.log2(F.col("pos") + F.lit(0.5))).cast("int")
    turns.withColumn("band", band).sortWithinPartitions("band", "pos").write.partitionBy("band").parquet(path)
    stored = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in turns.dtypes)}, band int").parquet(path)

    def at(depth: int) -> DataFrame:
        return stored.where((F.col("band") == depth.bit_length() - 1) & (F.col("pos") == depth)).drop("band", "pos")

    return at, stored.drop("band")


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns (conv_id, pos from 1 without gaps, turn_key, points)`` and ``ids (conv_id)``, which has
    turnless conversations too: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``. Without a conversation there is no node, not even the root."""
    spark = turns.sparkSession
    long = lambda v: F.lit(v).cast("long")
    seqs, member = sequences(turns, ids)
    if seqs.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    named = turns.join(member.where("conv_id = seq").select("conv_id"), "conv_id", "left_semi").withColumnRenamed("conv_id", "seq")
    seg = F.floor(F.col("pos") / SEGMENT).cast("long")
    at, every = _banded(_running(named, "seq", seg, [F.col("pos")], F.col("points"), "upto").select("seq", "pos", "turn_key", "points", "upto"))

    # down: levels[d] has the nodes of depth d, (conv_id, parent, n_convs, n_seqs, points, ends, below, saved)
    info = seqs.select("seq", "weight", "size", F.col("points").alias("whole"), "ends")
    all_of = seqs.agg(F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_seqs"), F.max(F.when(F.col("size") == 0, F.col("ends"))).alias("ends")).first()
    root_alone = all_of["n_seqs"] == 1
    live = cut(info.withColumn("parent", long(all_of["conv_id"])).where("size > 0"))
    levels: list[DataFrame] = []
    tails: list[DataFrame] = []  # sequences that are alone from a depth on
    if root_alone:
        tails.append(live.select("seq", "weight", "size", "whole", "ends").withColumn("from", long(0)))
        live = live.where("false")
    depth = 0
    while not live.isEmpty():
        depth += 1
        step = live.join(at(depth), "seq")
        key = ["parent", "turn_key"]
        rest = F.when(F.col("n_seqs") == 1, (F.col("n_convs") - 1) * (F.col("whole") - F.col("upto") + F.col("points")))
        nodes = step.groupBy(*key).agg(
            F.min("seq").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.count("*").alias("n_seqs"),
            *(F.max(c).alias(c) for c in ("points", "upto", "whole", "size")),
            F.max(F.when(F.col("size") == depth, F.col("ends"))).alias("ends"),
        )
        level = cut(nodes.select("conv_id", "parent", "turn_key", "n_convs", "n_seqs", "points", "ends", (F.col("size") > depth).alias("below"), rest.alias("saved")))
        levels.append(level)
        onward = step.where(F.col("size") > depth).join(level.select(*key, F.col("conv_id").alias("node"), "n_seqs"), key)
        onward = cut(onward.select("seq", "weight", "size", "whole", "ends", F.col("node").alias("parent"), "n_seqs"))
        tails.append(onward.where("n_seqs = 1").select("seq", "weight", "size", "whole", "ends", long(depth).alias("from")))
        live = onward.where("n_seqs > 1").drop("n_seqs")

    # up: what hangs on a node of several sequences comes from the level below
    out: list[DataFrame] = []
    below = None
    for d in range(depth, 0, -1):
        level = levels[d - 1]
        if below is not None:
            level = level.join(below, "conv_id", "left")
        else:
            level = level.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "gained")})
        one = F.col("n_seqs") == 1
        done = level.select(
            "conv_id",
            long(d).alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            F.when(one, F.col("below").cast("long")).otherwise(F.coalesce("children", long(0))).alias("n_children"),
            F.when(one, long(1)).otherwise(F.coalesce("leaves", long(1))).alias("n_leaves"),
            F.when(one, F.col("saved")).otherwise((F.col("n_convs") - 1) * F.col("points") + F.coalesce("gained", long(0))).alias("saved_tokens"),
            F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
        )
        done = cut(done)
        out.append(done)
        below = done.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("gained"))
    top = {"children": 0, "leaves": 0, "gained": 0}
    if below is not None:
        top = below.first().asDict()
    elif root_alone:
        only = seqs.first()
        top = {"children": int(only["size"] > 0), "leaves": 1, "gained": (only["weight"] - 1) * only["points"]}
    root = [(all_of["conv_id"], 0, None, all_of["n_convs"], top["children"], max(1, top["leaves"]), top["gained"], all_of["ends"] or EMPTY)]
    out.append(spark.createDataFrame(root, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"))
    alone = reduce(DataFrame.unionByName, tails)
    chain = every.join(alone, "seq").where(F.col("pos") > F.col("from"))
    last = F.col("pos") == F.col("size")
    out.append(
        chain.select(
            F.col("seq").alias("conv_id"),
            F.col("pos").alias("depth"),
            F.col("seq").alias("parent_conv_id"),
            F.col("weight").alias("n_convs"),
            (~last).cast("long").alias("n_children"),
            long(1).alias("n_leaves"),
            ((F.col("weight") - 1) * (F.col("whole") - F.col("upto") + F.col("points"))).alias("saved_tokens"),
            F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
        )
    )
    return reduce(DataFrame.unionByName, out).select(*_NODE)


def conversation_trie(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int | None = None) -> DataFrame:
    """The prefix trie of conversations; a row per node, see :func:`prefix_trie`.

    Turns are ordered by (turn, role, text), nulls first; a null role or text is empty. Repeated rows are turns of
    their own. Rows with a null conversation id belong to none and are left out; an empty table gives no rows.
    Turns are the same if role and text are. Other columns are not read. ``saved_tokens`` counts code points that the conversations of
    a subtree share. With ``family`` conversations are rebuilt by :func:`with_heads` first."""
    turns = cut(numbered(chats, conv_col, turn_col, role_col, text_col))
    ids = turns.select("conv_id").distinct()
    if family is not None:
        turns = cut(with_heads(turns, ids, family))
    return prefix_trie(turns, ids)


#: DuckDB's version: prefixes as running texts of digests; each node's subtree from the pairs of prefixes of one conversation.
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS first, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM t),
b AS (SELECT h.conv_id, 0 AS part, pos, role, text FROM h JOIN t ON t.conv_id = h.first AND pos <= h.h
      UNION ALL SELECT h.conv_id, 1, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h.h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM b),
k AS (SELECT conv_id, depth, length(text) AS points, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS key FROM n
      UNION ALL SELECT conv_id, 0, 0, 'root' FROM h),
nodes AS MATERIALIZED (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points FROM k GROUP BY depth, key),
links AS (SELECT DISTINCT c.depth, c.key, p.key AS parent FROM k c JOIN k p ON c.conv_id = p.conv_id AND p.depth = c.depth - 1),
children AS (SELECT parent AS key, count(*) AS n_children FROM links GROUP BY parent),
pairs AS (SELECT DISTINCT a.depth, a.key, d.depth AS below, d.key AS other FROM k a JOIN k d ON a.conv_id = d.conv_id AND d.depth >= a.depth),
sums AS (SELECT p.depth, p.key, count(*) FILTER (WHERE c.key IS NULL) AS n_leaves, sum((n_convs - 1) * points) AS saved FROM pairs p JOIN nodes n ON n.depth = p.below AND n.key = p.other LEFT JOIN children c ON c.key = p.other GROUP BY p.depth, p.key),
lasts AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
ends AS (SELECT k.depth, key, string_agg(k.conv_id::VARCHAR, ',' ORDER BY k.conv_id) AS ids FROM k JOIN lasts ON k.conv_id = lasts.conv_id AND k.depth = lasts.depth GROUP BY k.depth, key)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN links l ON n.depth = l.depth AND n.key = l.key LEFT JOIN nodes p ON p.depth = l.depth - 1 AND p.key = l.parent
LEFT JOIN children c ON c.key = n.key JOIN sums s ON s.depth = n.depth AND s.key = n.key LEFT JOIN ends e ON e.depth = n.depth AND e.key = n.key
"""
