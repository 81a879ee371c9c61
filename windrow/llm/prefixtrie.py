"""Prefix trie of conversations by partition refinement.

All conversations start in one class.  In each round the classes that are
still active are split by their members' next turn; a class that holds one
distinct conversation only retires, and its tail, a chain of nodes with one
child each, is written out at once.  Sums over subtrees are folded back from
the deepest level to the root.

Turns travel as SHA-256 digests with a length, never as text.  Copies of a
whole conversation are one weighted row, so rounds go only as deep as
*different* conversations agree.  Ranks and running lengths within a
conversation come from a global sort whose partitions hand a carry on, so a
conversation that holds a large share of all rows is no single task; a split
is a partially aggregated count followed by an equi-join that adaptive
execution may cut at a hot turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.shared import drop_stored, is_empty, stored, table

#: Turns taken from the conversation that opens a block, at most ``HEADS - 1``, and conversations in a block.
HEADS, BLOCK = 6, 100

_NUMBERED = "conv long, key binary, len long, part int, local long, local_before long"


def head(conv: Column) -> Column:
    """How many first turns of conversation ``conv`` come from the one that opens its block."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("long")


def _runs(conv: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    return np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if len(conv) else np.zeros(0, np.int64)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and running length of each row within its conversation, counted from the start of the sorted partition."""
    part, last, n, chars = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, size = np.asarray(batch.column("conv"), np.int64), np.asarray(batch.column("len"), np.int64)
        start = _runs(conv)
        count = np.diff(np.append(start, len(conv)))
        local = np.arange(len(conv)) - np.repeat(start, count)
        before = np.cumsum(size) - size
        before -= np.repeat(before[start], count)
        if conv[0] == last:
            local[: count[0]] += n
            before[: count[0]] += chars
        last, n, chars = conv[-1], local[-1] + 1, before[-1] + size[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("key"), batch.column("len"), pa.array(np.full(len(conv), part, np.int32)), pa.array(local), pa.array(before)], names=["conv", "key", "len", "part", "local", "local_before"]
        )


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, key, len, before`` of every turn: its 0-based place by turn (null first, ties by digest), digest, length and the length of all turns before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    plain = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("key"), F.length(text).cast("long").alias("len")
    )
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("key").asc()]
    numbered = stored(plain.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, _NUMBERED), "turns")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("len").alias("l"))
    # only the first conversation of a partition has rows in earlier ones: a row a partition at most
    carry = parts.select("conv", "part", F.sum("n").over(earlier).alias("n"), F.sum("l").over(earlier).alias("l")).where("n > 0")
    out = numbered.join(F.broadcast(carry), ["conv", "part"], "left")
    return out.select("conv", (F.col("local") + F.coalesce("n", F.lit(0))).alias("pos"), "key", "len", (F.col("local_before") + F.coalesce("l", F.lit(0))).alias("before"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with their heads exchanged: (turns as in :func:`ordered_turns`, ``conv`` of all, turnless ones included).

    Conversation c gets the first ``head(c)`` turns of conversation
    c - c % BLOCK (all if it has fewer, none if it does not exist), then its
    own turns after its first ``head(c)``.
    """
    own = F.col("pos") < head(F.col("conv"))
    convs = turns.groupBy("conv").agg(F.coalesce(F.sum(F.when(own, F.col("len"))), F.lit(0)).alias("own_head"))
    convs = convs.withColumn("h", head(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    # at most HEADS - 1 turns of one conversation in each block
    first = turns.where((F.col("conv") % BLOCK == 0) & (F.col("pos") < HEADS - 1))
    first = first.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "len", "before"))).alias("first"))
    convs = convs.join(first, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("n_head", F.size("first").cast("long")).withColumn("head_len", F.aggregate("first", F.lit(0).cast("long"), lambda t, x: t + x["len"]))
    convs = stored(convs, "heads")
    heads = convs.select("conv", F.explode("first").alias("x")).select("conv", "x.pos", "x.key", "x.len", "x.before")
    tails = turns.join(convs.select("conv", "h", "own_head", "n_head", "head_len"), "conv").where("pos >= h")
    tails = tails.select("conv", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "key", "len", (F.col("before") - F.col("own_head") + F.col("head_len")).alias("before"))
    return heads.union(tails), convs.select("conv")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members of one group, joined by commas."""
    for batch in batches:
        rep, conv = (np.asarray(batch.column(c), np.int64) for c in ("rep", "conv"))
        start = _runs(rep)
        pieces = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(start, np.append(start, len(rep))[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rep[start]), pa.array(conv[start]), pa.array(pieces, pa.string())], names=["rep", "first", "piece"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's pieces in order, fed piece by piece: one piece is held at a time."""
    last, state = None, None
    for batch in batches:
        done = []
        for rep, piece in zip(batch.column("rep").to_pylist(), batch.column("piece"), strict=True):
            if rep != last:
                if state is not None:
                    done.append((last, state.hexdigest()))
                last, state = rep, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["rep", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "sha"])


def member_digests(members: DataFrame) -> DataFrame:
    """``rep, sha``: digest of the members of each group of ``members(rep, conv)``, ascending, comma-joined.

    SHA-256 is sequential, so a group's digest is made by one task, but from
    pieces of many ids that stream through it; sorting and joining happen in
    range partitions that may cut a group anywhere.
    """
    packed = members.repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(_packed, "rep long, first long, piece string")
    return packed.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_digested, "rep long, sha string")


def refined(turns: DataFrame, reps: DataFrame) -> list[DataFrame]:
    """Classes of every depth from 0 (all conversations) on, as stored tables.

    ``turns(rep, pos, key, len, before)`` and ``reps(rep, w, n, total)``
    describe distinct conversations: weight, turns and length.  A class is
    ``conv_id, parent, n_seq, n_convs, len, before, n, total, end_rep``; the
    numbers of a single conversation are right where ``n_seq`` is 1.
    """
    of_class = [F.min("rep").alias("conv_id"), F.count("*").alias("n_seq"), F.sum("w").alias("n_convs"), F.max("len").alias("len"), F.max("before").alias("before"), F.max("n").alias("n"), F.max("total").alias("total")]
    end = lambda depth: F.min(F.when(F.col("n") == depth, F.col("rep"))).alias("end_rep")
    zero = F.lit(0).cast("long")
    root = reps.withColumn("len", zero).withColumn("before", zero).agg(*of_class, end(0)).where("n_seq > 0")
    levels = [stored(root.select(F.lit(None).cast("long").alias("parent"), *root.columns), "level")]
    active = reps.crossJoin(F.broadcast(levels[0].where("n_seq > 1").select(F.col("conv_id").alias("class"))))  # one row
    steps = []
    while not is_empty(levels[-1].where("n_seq > 1")):
        depth = len(levels)
        step = stored(active.join(turns.where(F.col("pos") == depth - 1).drop("pos"), "rep"), "step")
        steps.append(step)
        level = step.groupBy(F.col("class").alias("parent"), "key").agg(*of_class, end(depth))
        level = stored(level, "level")
        on = level.where("n_seq > 1").select(F.col("parent").alias("class"), "key", F.col("conv_id").alias("next"))
        active = step.join(on, ["class", "key"]).select("rep", "w", "n", "total", F.col("next").alias("class"))
        levels.append(level.drop("key"))
    drop_stored(*steps)
    return levels


def folded(levels: list[DataFrame]) -> list[DataFrame]:
    """Adds ``n_children, n_leaves, saved`` of the subtree to the classes of every level, from the deepest up; each level is stored."""
    below, out = None, []
    single = F.col("n_seq") == 1
    for depth in reversed(range(len(levels))):
        g = levels[depth]
        if below is None:
            g = g.selectExpr("*", "0L as kids", "0L as leaves", "0L as under")
        else:
            kids = below.groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("under"))
            g = g.join(kids, F.col("conv_id") == F.col("up"), "left").drop("up").fillna(0, ["kids", "leaves", "under"])
        saved = (F.col("n_convs") - 1) * F.when(single, F.col("total") - F.col("before")).otherwise(F.col("len")) + F.col("under")
        g = g.select(
            "conv_id", "parent", "n_seq", "n_convs", "n", "total", "end_rep",
            F.when(single, (F.col("n") > depth).cast("long")).otherwise(F.col("kids")).alias("n_children"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), saved.alias("saved"),
        )
        below = stored(g, "folded")
        out.append(below)
    return out[::-1]


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations, a row a node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``.  Null roles and texts are empty; rows without a conv_id
    belong to no conversation; turns of equal number are ordered by the digest
    of role and text; repeated rows are turns of their own.  No conversations,
    no nodes.  Other columns are not read, so their names do not matter.
    """
    all_turns, convs = rebuilt(ordered_turns(conversations))
    all_turns = stored(all_turns, "rebuilt")
    contents = all_turns.select("conv", F.xxhash64("pos", "key").alias("a"), F.xxhash64("key", "pos", F.lit("b")).alias("b"), F.lit(1).cast("long").alias("one"), "len")
    nothing = convs.select("conv", *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "one", "len")))
    # 128 bits of order-free digest name a whole conversation, by partial sums
    whole = contents.union(nothing).groupBy("conv").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("one").alias("n"), F.sum("len").alias("total"))
    whole = stored(whole, "whole")
    copies = stored(whole.groupBy("a", "b", "n").agg(F.min("conv").alias("rep"), F.count("*").alias("w"), F.max("total").alias("total")), "copies")
    reps = copies.select("rep", "w", "n", "total")
    # rounds read one depth each: rows lie by depth, so that files and row groups of others are skipped
    distinct = all_turns.join(reps.select(F.col("rep").alias("conv")), "conv", "left_semi").withColumnRenamed("conv", "rep")
    distinct = stored(distinct.repartitionByRange("pos", "rep").sortWithinPartitions("pos", "rep"), "by-depth")
    levels = refined(distinct, reps)
    done = folded(levels)
    nodes = [g.select("conv_id", F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "end_rep") for d, g in enumerate(done)]
    alone = reduce(DataFrame.union, (g.where("n_seq = 1").select(F.col("conv_id").alias("rep"), F.lit(d).cast("long").alias("from"), F.col("n_convs").alias("w"), "n", "total") for d, g in enumerate(done)))
    chain = distinct.join(alone, "rep").where("pos >= from")
    last = F.col("pos") + 1 == F.col("n")
    nodes.append(
        chain.select(
            F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("w").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("w") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"), F.when(last, F.col("rep")).alias("end_rep"),
        )
    )
    many = copies.where("w > 1").select("a", "b", "n", "rep")
    digests = stored(member_digests(whole.join(many, ["a", "b", "n"]).select("rep", "conv")), "digests").withColumnRenamed("rep", "end_rep")
    out = reduce(DataFrame.union, nodes).join(digests, "end_rep", "left")
    of_one = F.sha2(F.coalesce(F.col("end_rep").cast("string"), F.lit("")).cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", of_one).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Contract query: the trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), names AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM turns)
), crc AS (
  SELECT conv_id, s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM names
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, CAST(k // 8 + 1 AS INT), 1)) AS BIGINT)) ELSE v END AS w FROM crc WHERE k < 8 * length(s))
), heads AS (
  SELECT names.conv_id, names.base, xor(v, 4294967295) % 6 AS h FROM crc JOIN names USING (conv_id) WHERE k = 8 * length(crc.s)
), joined AS (
  SELECT heads.conv_id, 0 AS part, pos, role, text FROM heads JOIN turns ON turns.conv_id = base WHERE pos < h
  UNION ALL
  SELECT conv_id, 1, pos, role, text FROM heads JOIN turns USING (conv_id) WHERE pos >= h
), whole AS (
  SELECT heads.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (WHERE role IS NOT NULL), []) AS seq FROM heads LEFT JOIN joined USING (conv_id) GROUP BY 1
), prefixes AS (
  SELECT conv_id, d AS depth, seq[1:d] AS path, d = len(seq) AS ends FROM whole, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS members,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].text) END AS saved
  FROM prefixes GROUP BY 1, 2
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1 : n.depth - 1]
), counted AS (
  SELECT n.*, (SELECT count(*) FROM linked k WHERE k.depth = n.depth + 1 AND k.path[1 : n.depth] = n.path) AS n_children FROM linked n
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, CAST(sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(k.saved) AS BIGINT) AS saved_tokens, sha256(n.members) AS ends_sha256
FROM counted n JOIN counted k ON k.depth >= n.depth AND k.path[1 : n.depth] = n.path
GROUP BY n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.members, n.path
"""
