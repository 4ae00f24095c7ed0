"""Queries that place the timer keys on a ring of members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import codec
from tickledger.operators import shards
from tickledger.plans.shape import plain
from tickledger.session import configure
from tickledger.sources import sample

KEY = S.KEY_COLUMNS
RING_PARTITIONS = 256


def _members(spark: SparkSession, sf: str, after: bool = False) -> DataFrame:
    """Suppliers as members; those in debt leave the group."""
    suppliers = configure(spark).read.parquet(f"{sf}/supplier.parquet")
    kept = suppliers.where(F.col("s_acctbal") >= 0) if after else suppliers
    return kept.select(F.col("s_name").alias("member"))


def _nodes(spark: SparkSession, sf: str, after: bool = False) -> DataFrame:
    return shards.ring_nodes(_members(spark, sf, after), RING_PARTITIONS)


def _owners(spark: SparkSession, sf: str, after: bool = False) -> DataFrame:
    return shards.partition_owners(_nodes(spark, sf, after), RING_PARTITIONS)


def _key_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sample.records(spark, sf).where(F.col("kind") != codec.MARKER).select(*KEY)


def sort_ring(spark: SparkSession, sf: str) -> DataFrame:
    return plain(shards.sort_ring(_nodes(spark, sf)))


def ring_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return plain(shards.ring_ranges(_nodes(spark, sf), RING_PARTITIONS))


def ring_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = _key_rows(spark, sf).distinct()
    return plain(shards.key_shards(keys, _owners(spark, sf), RING_PARTITIONS))


def assignment_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = shards.assignment_lists(_members(spark, sf), _owners(spark, sf))
    return plain(
        lists.select(
            "member",
            F.size("partitions").alias("n"),
            F.array_join(F.col("partitions").cast("array<string>"), ",").alias("partitions"),
        )
    )


def assignment_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lost, gained and kept partitions with the timer keys they hold."""
    diff = shards.assignment_diff(_owners(spark, sf), _owners(spark, sf, after=True))
    placed = shards.key_shards(_key_rows(spark, sf).distinct(), _owners(spark, sf), RING_PARTITIONS)
    counts = placed.groupBy("partition").agg(F.count(F.lit(1)).alias("keys"))
    return plain(diff.join(counts, "partition", "left").fillna(0, ["keys"]))


def _key_assignments(spark: SparkSession, sf: str, after: bool) -> DataFrame:
    keys = _key_rows(spark, sf).distinct()
    return shards.key_shards(keys, _owners(spark, sf, after), RING_PARTITIONS).select("member", *KEY)


def difference_assignments(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_key_assignments(spark, sf, False).subtract(_key_assignments(spark, sf, True)))


def intersect_assignments(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_key_assignments(spark, sf, False).intersect(_key_assignments(spark, sf, True)))


def moved_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = _key_rows(spark, sf).distinct()
    return plain(shards.moved_keys(keys, _owners(spark, sf), _owners(spark, sf, True), RING_PARTITIONS))


def shard_load(spark: SparkSession, sf: str) -> DataFrame:
    return plain(shards.shard_load(_key_rows(spark, sf), _members(spark, sf), _owners(spark, sf), RING_PARTITIONS))


QUERIES = {
    f.__name__: f
    for f in (
        sort_ring, ring_ranges, ring_lookup, assignment_lists, assignment_diff, difference_assignments,
        intersect_assignments, moved_keys, shard_load,
    )
}
