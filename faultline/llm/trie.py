"""Prefix trie of conversations, built level by level: per depth, live conversations are grouped by (parent node, next turn).

A node is named by its depth and its smallest conversation. A conversation that is alone in its node needs no more
grouping, as the rest of it is a chain. Leaves and savings are then rolled up by joins, level by level, from the deepest.
Turns travel as SHA-256 digests and lengths; their texts stay in the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Turns of a conversation that meet its other figures under one key, and nodes of a chain that one row unfolds to.
BLOCK = 65_536
#: A group of a level that holds more than one in so many of its conversations is hot; there can't be more of them than that.
HOT = 1_000
#: Conversation ids that are digested as one piece.
PIECE = 65_536
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_key() -> Column:
    """Identity of a turn: SHA-256 of role and text, the role led by its bytes. Null is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation get their place among those of it in this task, and the task's number."""
    part, before, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        place = np.arange(len(ids)) - np.repeat(starts, np.diff([*starts, len(ids)]))
        if ids[0] == before:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        before, seen = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "key": batch.column("key"), "chars": batch.column("chars"), "place": pa.array(place, pa.int64()), "part": pa.array(np.full(len(ids), part), pa.int32())})


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, key, chars), and conversations (conv_id, n), at being a turn's place from 0.

    Turns go by `turn`, null first, ties by their key. A conversation of any length is dealt over tasks: turns are sorted by
    range, numbered in each task, and moved on by what earlier tasks hold of their conversation.
    """
    given = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key().alias("key"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = given.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "chars")
    turns = common.written(dealt.mapInArrow(_number, "conv_id long, key binary, chars long, place long, part int"), "turns")
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.expr("sum(n) over (partition by conv_id order by part rows between unbounded preceding and 1 preceding)"))
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    moved = parts.where("before > 0").select("conv_id", "part", "before")  # a row for each task's first conversation at most
    turns = turns.join(F.broadcast(moved), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("at"), "key", "chars")
    return turns, convs


def shared_openings(conversations: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that those of a family begin alike: turns (conv_id, depth from 1, key, chars), conversations (conv_id, length).

    Conversation c gets the first h turns of conversation c - c % family (all if it has fewer, none if it is absent), then
    its own turns after its first h; h is the unsigned CRC-32 of c's decimal digits modulo `most`. % takes the sign of c.
    """
    turns, convs = numbered(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    first = F.col("conv_id") - F.col("conv_id") % family
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    convs = convs.select("conv_id", "n", h, first.alias("head")).join(heads, "head", "left").withColumn("opening", F.least("h", F.coalesce("head_n", F.lit(0))))
    convs = common.written(convs.select("conv_id", "n", "h", "head", "opening", (F.col("opening") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    opened = turns.where((F.col("conv_id") % family == 0) & (F.col("at") < most - 1)).withColumnRenamed("conv_id", "head")
    opened = opened.join(convs.select("conv_id", "head", "opening"), "head").where("at < opening").select("conv_id", (F.col("at") + 1).alias("depth"), "key", "chars")
    block = (F.col("at") / BLOCK).cast("long").alias("block")
    blocks = convs.where("n > h").select("conv_id", "h", "opening", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / BLOCK).cast("long"))).alias("block"))
    own = turns.select("*", block).where(F.col("at") >= h).join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("at") - F.col("h") + F.col("opening") + 1).alias("depth"), "key", "chars")
    return common.written(opened.unionByName(own).sortWithinPartitions("depth"), "rebuilt"), convs.select("conv_id", "length")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node, joined by commas, PIECE at most to a row."""

    def out(key: tuple[int, int], ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "node": [key[1]], "first": [ids[0]], "text": [",".join(map(str, ids))]}, schema=pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("text", pa.string())]))

    key, ids = None, []
    for batch in batches:
        for depth, node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv_id"))):
            if (depth, node) != key or len(ids) == PIECE:
                if ids:
                    yield out(key, ids)
                key, ids = (depth, node), []
            ids.append(conv)
    if ids:
        yield out(key, ids)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of a node's pieces, one after the other."""
    schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])
    key, sha = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for depth, node, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "text"))):
            if (depth, node) != key:
                if sha:
                    done.append((*key, sha.hexdigest()))
                key, sha = (depth, node), hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema=schema)
    if sha:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, sha.hexdigest())))], schema=schema)


def ends(ended: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of ended conversations (depth, node, conv_id): ids are joined where the sort has put them, so that
    a node in which very many end is digested from a few long pieces."""
    order = ["depth", "node", "conv_id"]
    pieces = ended.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, node long, first long, text string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, ends_sha256 string")


def _assigned(step: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Conversations of `step` that share their group, with its node. Hot groups come by broadcast, HOT rows at most, and their conversations don't meet in the shuffle for the others."""
    shared = groups.where("n > 1").select("parent", "key", F.col("conv_id").alias("named"))
    hot = groups.where((F.col("n") > 1) & (F.col("n") > total // HOT)).select("parent", "key", F.col("conv_id").alias("hot"))
    other = groups.where((F.col("n") > 1) & (F.col("n") <= total // HOT)).select("parent", F.col("key").alias("asked"), F.col("conv_id").alias("named"))
    if total <= HOT:  # no group is small enough for the other way
        return step.join(F.broadcast(shared), ["parent", "key"]).select("conv_id", F.col("named").alias("node"), "length")
    met = step.join(F.broadcast(hot), ["parent", "key"], "left").withColumn("asked", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.col("conv_id").cast("string").cast("binary")))
    met = met.join(other, ["parent", "asked"], "left").withColumn("node", F.coalesce("hot", "named"))
    return met.where("node is not null").select("conv_id", "node", "length")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of turns (conv_id, depth from 1 without gaps, key, chars) and convs (conv_id, length), one row each.

    conv_id is the node's smallest member, with `depth` its name; parent_conv_id that of its parent, null for the root;
    n_convs, n_children, n_leaves count members, children and childless nodes of its subtree, itself included; saved_tokens
    sums (n_convs - 1) x code points of the node's turn over its subtree; ends_sha256 is the SHA-256 of the ids of members
    that end here, ascending and joined by commas. There are as many rounds as the longest beginning that differs
    nowhere between two conversations has turns. No conversations: no rows.
    """
    spark = convs.sparkSession
    total, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return spark.createDataFrame([], NODES)
    live = convs.where("length > 0").select("conv_id", F.lit(least).alias("parent"), "length")
    over = [convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(least).alias("node"), "conv_id")]
    levels: list[DataFrame] = []
    while True:
        depth = len(levels) + 1
        step = turns.where(F.col("depth") == depth).join(live, "conv_id").select("conv_id", "parent", "key", "chars", "length")
        groups = step.groupBy("parent", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("length").alias("length"))
        levels.append(common.written(groups, f"level-{depth}"))
        shared, members = levels[-1].where("n > 1").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not shared:
            break
        assigned = common.written(_assigned(step, levels[-1], members), f"live-{depth}")
        over.append(assigned.where(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        live = assigned.where(F.col("length") > depth).select("conv_id", F.col("node").alias("parent"), "length")
    return _rolled_up(spark, levels, over, total, least)


def _rolled_up(spark: SparkSession, levels: list[DataFrame], over: list[DataFrame], total: int, least: int) -> DataFrame:
    sums, shared, alone = None, [], []
    no = F.lit(0).cast("long")
    below = lambda nodes, sums: nodes.join(sums, nodes.conv_id == sums.above, "left") if sums is not None else nodes.withColumns({"children": no, "leaves": no, "saved": no})
    rolled = lambda nodes: nodes.select("*", F.coalesce("children", no).alias("n_children"), F.greatest(F.coalesce("leaves", no), F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("chars") + F.coalesce("saved", no)).alias("saved_tokens")).drop("children", "leaves", "saved", "above")
    for depth in range(len(levels), 0, -1):
        level = levels[depth - 1]
        nodes = common.written(rolled(below(level.where("n > 1").select("conv_id", "parent", "n", "chars"), sums)), f"up-{depth}")
        single = level.where("n = 1").select("conv_id", "parent", "length")
        both = nodes.select("parent", "n_leaves", "saved_tokens").unionByName(single.select("parent", F.lit(1).cast("long").alias("n_leaves"), no.alias("saved_tokens")))
        sums = both.groupBy(F.col("parent").alias("above")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        shared.append(nodes.withColumn("depth", F.lit(depth).cast("long")))
        alone.append(single.withColumn("depth", F.lit(depth).cast("long")))
    root = spark.createDataFrame([(least, None, total, 0)], "conv_id long, parent long, n long, chars long")
    shared.append(rolled(below(root, sums)).withColumn("depth", no))

    ended = ends(_together(over)).withColumnRenamed("depth", "at")
    nodes = _together(shared)
    nodes = nodes.join(ended, (nodes.depth == ended["at"]) & (nodes.conv_id == ended.node), "left")
    nodes = nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    # The rest of a conversation that is alone in its node: unfolded by blocks, which are dealt anew where there are several.
    chains = _together(alone).withColumn("block", F.explode(F.sequence(no, ((F.col("length") - F.col("depth")) / BLOCK).cast("long"))))
    chains = chains.select("*", (F.col("depth") + F.col("block") * BLOCK).alias("from")).repartition("conv_id", "block")
    chains = chains.withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("length"), F.col("from") + BLOCK - 1))))
    last, one = F.col("at") == F.col("length"), F.lit(1).cast("long")
    chains = chains.select("conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), no.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"))
    return nodes.unionByName(chains)


def _together(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    return found


def conversation_trie(conversations: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """prefix_trie of shared_openings.

    Rows without conv_id are left out; null role or text is empty; repeated rows are turns of their own, turns of equal
    number go by their key; other columns play no part; an empty table gives no rows.
    """
    return prefix_trie(*shared_openings(conversations, family, most))
