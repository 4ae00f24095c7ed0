"""Prefix trie of conversations: one ROLLUP over positional turn columns gives all prefixes together.

A turn is known by two longs, hashes of role and text of which the second also holds the text's
length. A conversation is cut into blocks of ``WIDTH`` turns; a block is one row with a pair of
columns per position and the key of the node that the block before ended in. ``GROUP BY block,
key, ROLLUP(...)`` then counts every prefix of every block, and ``grouping_id`` tells its depth.
The key of a node is the exclusive or of a hash of each (position, turn) on its path, so running
values give the keys of all blocks without going from block to block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickledger.llm import texts as X
from tickledger.operators.skew import split_join

WIDTH = 4
# Running values are made inside chunks of this many rows of a conversation and carried over.
CHUNK = 1 << 17
# Ids of one stretch of numbers are joined to a text of about a megabyte at most.
STRETCH_BITS = 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position from 1, turn_a, turn_b): the turns of each conversation in order.

    Order is by ``turn``, null first, then role and text; null roles and texts are empty, repeated
    rows are turns of their own. Rows without a conversation id are left out. The table is sorted
    as a whole by ranges and numbered inside its parts, so a conversation of any length is spread
    over several tasks.
    """
    filled = conversations.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    rows = filled.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    length = F.char_length("text").cast("bigint")
    placed = X.stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv_id",
            F.monotonically_increasing_id().alias("at"),
            F.xxhash64(F.lit(1), "role", "text").alias("turn_a"),
            F.shiftleft(F.xxhash64(F.lit(2), "role", "text"), 31).bitwiseOR(length).alias("turn_b"),
        ),
        "turns",
    ).withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("position"), "turn_a", "turn_b"
    )


def with_heads(turns: DataFrame, donor: Column, n_head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``n_head`` turns replaced by those of its donor: (turns, all conversations).

    ``donor`` and ``n_head`` (at most ``longest``) are expressions of ``conv_id``. A donor with fewer
    turns gives all it has, an absent one none; the result may have no turns at all.
    """
    convs = turns.select("conv_id").distinct().select("conv_id", donor.alias("donor"), n_head.cast("int").alias("cut"))
    head = F.array_sort(F.collect_list(F.struct("position", "turn_a", "turn_b")))
    heads = turns.where(F.col("position") <= longest).groupBy(F.col("conv_id").alias("donor")).agg(head.alias("head"))
    given = F.when(F.col("cut") > 0, F.slice("head", F.lit(1), F.greatest("cut", F.lit(1))))
    convs = convs.join(heads, "donor", "left").select("conv_id", "cut", F.coalesce(given, F.array().cast("array<struct<position:bigint,turn_a:bigint,turn_b:bigint>>")).alias("head"))
    convs = X.stored(convs, "heads")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    own = turns.join(convs.select("conv_id", "cut", F.size("head").alias("given")), "conv_id").where(F.col("position") > F.col("cut"))
    own = own.withColumn("position", F.col("position") - F.col("cut") + F.col("given")).select(*first.columns)
    return first.unionByName(own), convs.select("conv_id")


def running(df: DataFrame, number: Column, fold: Callable[[Column], Column], add: Callable[[Column, Column], Column], values: dict[str, str]) -> DataFrame:
    """``df`` with the fold of ``values`` over the earlier rows of its conversation, in the order of ``number``.

    Folds inside chunks of ``CHUNK`` numbers need no more than these rows in one place; the totals
    of the chunks, one row each, are carried forward.
    """
    rows = df.withColumn("_number", number).withColumn("_chunk", F.floor(F.col("_number") / CHUNK))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "_chunk").agg(*[fold(F.col(v)).alias(f"_{v}") for v in values])
    carried = totals.select("conv_id", "_chunk", *[fold(F.col(f"_{v}")).over(over).alias(f"_carried_{v}") for v in values]).where("_chunk > 0")
    rows = rows.select("*", *[fold(F.col(v)).over(inside).alias(f"_inside_{v}") for v in values]).join(carried, ["conv_id", "_chunk"], "left")
    none = F.lit(0).cast("bigint")
    made = [add(F.coalesce(f"_inside_{v}", none), F.coalesce(f"_carried_{v}", none)).alias(name) for v, name in values.items()]
    return rows.select(*df.columns, *made)


def _term(position: Column, half: str, column: str) -> Column:
    """What one turn at one position adds to the key of the nodes below it."""
    return F.xxhash64(F.lit(half), position, F.col(column))


def blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: key of the node before it, and the turns by position."""
    at = F.col("position") - 1
    rows = turns.withColumn("block", F.floor(at / WIDTH)).withColumn("slot", F.pmod(at, F.lit(WIDTH)))
    columns = [F.max(F.when(F.col("slot") == i, F.col(f"turn_{h}"))).alias(f"{h}{i + 1}") for i in range(WIDTH) for h in "ab"]
    sums = [F.bit_xor(_term(F.col("position"), h, f"turn_{h}")).alias(f"sum_{h}") for h in "ab"]
    made = rows.groupBy("conv_id", "block").agg(*columns, *sums)
    return running(made, F.col("block"), F.bit_xor, lambda a, b: a.bitwiseXOR(b), {"sum_a": "key_a", "sum_b": "key_b"})


def _prefixes(made: DataFrame, measures: str) -> DataFrame:
    """The measures of every node below the root, with the node's key and that of its parent."""
    pairs = ", ".join(f"(a{i}, b{i})" for i in range(1, WIDTH + 1))
    columns = ", ".join(f"a{i}, b{i}" for i in range(1, WIDTH + 1))
    rows = made.sparkSession.sql(
        f"SELECT block, key_a, key_b, {columns}, {WIDTH} - bit_count(grouping_id()) DIV 2 AS level, {measures} "
        f"FROM {{made}} GROUP BY block, key_a, key_b, ROLLUP({pairs})",
        made=made,
    )
    last = F.coalesce(*[F.when(F.col("level") == i, F.col(f"b{i}")) for i in range(1, WIDTH + 1)])
    rows = rows.withColumn("last", last).where((F.col("level") > 0) & F.col("last").isNotNull())

    def key(half: str, less: int) -> Column:
        out = F.col(f"key_{half}")
        for i in range(1, WIDTH + 1):
            term = _term(F.col("block") * WIDTH + i, half, f"{half}{i}")
            out = out.bitwiseXOR(F.when(F.col("level") - less >= i, term).otherwise(F.lit(0).cast("bigint")))
        return out

    names = [c for c in rows.columns if c not in {"block", "level", "last", "key_a", "key_b"} and c[1:] not in {str(i) for i in range(1, WIDTH + 1)}]
    return rows.select(
        (F.col("block") * WIDTH + F.col("level")).alias("depth"),
        F.col("last").bitwiseAND(F.lit((1 << 31) - 1)).alias("n_chars"),
        key("a", 0).alias("node_a"), key("b", 0).alias("node_b"), key("a", 1).alias("parent_a"), key("b", 1).alias("parent_b"),
        *names,
    )


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end in each node, in order and comma-joined.

    The digest of one node is made in sequence by nature; the ids are sorted and joined in stretches
    before, so that the last step only streams texts through, one batch in memory at a time.
    """
    stretch = F.shiftright("conv_id", STRETCH_BITS).alias("stretch")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("node_a", "node_b", stretch).agg(ids.alias("ids"))
    pieces = pieces.repartition("node_a", "node_b").sortWithinPartitions("node_a", "node_b", "stretch")

    def digest(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for a, b, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if node == (a, b):
                    sha.update(b"," + piece.encode())
                    continue
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["node_a", "node_b", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, sha.hexdigest())], ["node_a", "node_b", "ends_sha256"])

    return pieces.mapInArrow(digest, "node_a bigint, node_b bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: node, parent, conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` is as from ``ordered``, ``convs`` holds every conversation once, those without turns
    too. Without conversations there is no node, not even the root. Every node belongs to its
    smallest member. That member also owns all longer prefixes it shares with nobody smaller, so
    the sum over a subtree is the sum of what its members own, less what the owner of its top owns
    above it: a second ROLLUP over the members' totals, no walk down the tree.
    """
    made = X.stored(blocks(turns), "blocks")
    whole = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "n_chars", "node_a", "node_b", "parent_a", "parent_b")]
    root = whole.where("n_convs > 0").select(*nothing, "n_convs", "conv_id")
    nodes = X.stored(_prefixes(made, "count(1) AS n_convs, min(conv_id) AS conv_id").unionByName(root), "nodes")

    below = nodes.where("depth > 0")
    children = below.groupBy(F.col("parent_a").alias("node_a"), F.col("parent_b").alias("node_b")).agg(F.count(F.lit(1)).alias("n_children"))
    owner = nodes.select(F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(children, ["node_a", "node_b"], "left").fillna(0, ["n_children"]).withColumn("saves", (F.col("n_convs") - 1) * F.col("n_chars"))
    rows = X.stored(running(rows, F.col("depth"), F.sum, lambda a, b: a + b, {"saves": "above"}), "owned")

    own = rows.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"))
    own = own.where("saves > 0 or leaves > 0")
    sums = _prefixes(split_join(made, own, ["conv_id"], "inner"), "sum(saves) AS saved, sum(leaves) AS n_leaves").select("node_a", "node_b", "saved", "n_leaves")
    total = own.agg(F.sum("saves").alias("saved"), F.sum("leaves").alias("n_leaves")).where("n_leaves > 0")
    sums = sums.unionByName(total.select(*nothing[2:4], "saved", "n_leaves"))

    ends = made.groupBy("conv_id").agg(*[F.bit_xor(f"sum_{h}").alias(f"node_{h}") for h in "ab"])
    ends = convs.join(ends, "conv_id", "left").fillna(0, ["node_a", "node_b"])
    rows = rows.join(sums, ["node_a", "node_b"], "left").fillna(0, ["saved", "n_leaves"])
    rows = rows.join(_digests(ends), ["node_a", "node_b"], "left").fillna(EMPTY_SHA256, ["ends_sha256"])
    rows = rows.join(owner, ["parent_a", "parent_b"], "left")
    name = lambda half: F.concat(*[F.lpad(F.hex(f"{half}_{h}"), 16, "0") for h in "ab"])
    inner = F.col("depth") > 0
    return rows.select(
        name("node").alias("node"), F.when(inner, name("parent")).alias("parent"),
        "conv_id", "depth", F.when(inner, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("saved") - F.col("above")).alias("saved_tokens"), "ends_sha256",
    )
