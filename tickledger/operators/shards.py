"""Place keys on shards with a hash ring, measure the load and find the keys that move.

The partition count is a fixed parameter of the log. Ring nodes that share a start are reduced to
the one that owns the range, so every table that is broadcast or ordered as a whole here has at
most ``partitions`` rows, however many members or keys there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import keys

KEY = S.KEY_COLUMNS
# fixed value: ring points of one member
POINTS = 2


def ring_nodes(members: DataFrame, partitions: int) -> DataFrame:
    """Ring points of the members: hash of name and point number, start = hash modulo partitions."""
    points = F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("point")
    hashed = members.select("member", points).withColumn(
        "hash", F.crc32(F.concat(F.col("member"), F.col("point").cast("string")).cast("binary"))
    )
    return hashed.withColumn("idx", F.pmod(F.col("hash"), F.lit(partitions).cast("bigint")).cast("int"))


def sort_ring(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("idx", "hash", "member")


def _starts(nodes: DataFrame, partitions: int) -> DataFrame:
    """Distinct starts with their owner and the end of the range; at most ``partitions`` rows."""
    owners = nodes.groupBy("idx").agg(F.max(F.struct("hash", "member")).alias("owner"))
    ring = Window.orderBy("idx")
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return owners.select(
        "idx",
        "owner",
        F.coalesce(F.lead("idx").over(ring), F.lit(partitions)).alias("range_end"),
        F.lead("idx").over(ring).isNull().alias("is_last"),
        F.first("idx").over(everything).alias("first_idx"),
    )


def ring_ranges(nodes: DataFrame, partitions: int) -> DataFrame:
    """Range of every ring point: [idx, range_end), plus [0, wrap_end) for the last one.

    Of points with the same start only the largest owns a range, the others' ranges are empty.
    """
    joined = nodes.join(F.broadcast(_starts(nodes, partitions)), "idx")
    owns = F.struct("hash", "member") == F.col("owner")
    return joined.select(
        "member",
        "point",
        "hash",
        "idx",
        F.when(owns, F.col("range_end")).otherwise(F.col("idx")).alias("range_end"),
        F.when(owns & F.col("is_last"), F.col("first_idx")).otherwise(F.lit(0)).alias("wrap_end"),
    )


def partition_owners(nodes: DataFrame, partitions: int) -> DataFrame:
    """Owner of every partition: the last point at or before it, wrapping to the last one."""
    starts = _starts(nodes, partitions)
    own = F.sequence(F.col("idx"), F.col("range_end") - 1)
    wrapped = F.when(
        F.col("is_last") & (F.col("first_idx") > 0),
        F.concat(own, F.sequence(F.lit(0), F.col("first_idx") - 1)),
    ).otherwise(own)
    return starts.select(F.col("owner.member").alias("member"), F.explode(wrapped).alias("partition"))


def key_shards(rows: DataFrame, owners: DataFrame, partitions: int) -> DataFrame:
    """Partition and owner of every key row; a map-side join with at most ``partitions`` rows."""
    placed = rows.withColumn("partition", keys.partition_of(F.col("timer_uuid"), partitions))
    return placed.join(F.broadcast(owners), "partition", "left")


def assignment_lists(members: DataFrame, owners: DataFrame) -> DataFrame:
    """Sorted partitions of every member; members without any keep an empty list.

    A list holds at most ``partitions`` numbers.
    """
    lists = owners.groupBy("member").agg(F.sort_array(F.collect_list("partition")).alias("partitions"))
    return members.join(lists, "member", "left").select(
        "member", F.coalesce(F.col("partitions"), F.array().cast("array<int>")).alias("partitions")
    )


def assignment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(member, partition) pairs as lost, gained or kept."""
    on = ["member", "partition"]
    left = old.select(*on, F.lit(True).alias("_old"))
    right = new.select(*on, F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_new").isNull(), "lost").when(F.col("_old").isNull(), "gained").otherwise("kept")
    )
    return left.join(right, on, "full").select(*on, status.alias("status"))


def shard_load(rows: DataFrame, members: DataFrame, owners: DataFrame, partitions: int) -> DataFrame:
    """Keys and rows of every member, and its rows relative to the mean of all.

    Members that own no partition, or only empty ones, are there with zeros. Rows are first counted
    per key inside the map tasks, which also makes the keys distinct.
    """
    per_key = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    load = (
        key_shards(per_key, owners, partitions)
        .groupBy("member")
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows"))
    )
    load = members.select("member").distinct().join(load, "member", "left").fillna(0, ["keys", "rows"])
    mean = F.avg("rows").over(Window.partitionBy(F.lit(1)))
    return load.withColumn("skew", F.try_divide(F.col("rows"), mean))


def moved_keys(rows: DataFrame, old: DataFrame, new: DataFrame, partitions: int) -> DataFrame:
    """Keys whose owner changes; both owner tables are looked up in the map tasks."""
    before = key_shards(rows, old.withColumnRenamed("member", "old_member"), partitions)
    after = before.join(F.broadcast(new.withColumnRenamed("member", "new_member")), "partition", "left")
    return after.where(~F.col("old_member").eqNullSafe(F.col("new_member")))
