import random
import zlib

from tickledger.operators import shards


def _naive(members, partitions):
    ring = sorted(
        (zlib.crc32(f"{m}{i}".encode()) % partitions, zlib.crc32(f"{m}{i}".encode()), m) for m in members for i in range(2)
    )
    owners = {}
    for p in range(partitions):
        at_or_before = [node for node in ring if node[0] <= p]
        owners[p] = (at_or_before or ring)[-1][2]
    return owners


def test_every_partition_has_the_expected_owner(spark):
    rng = random.Random(4)
    for partitions in (1, 2, 7, 64):
        for size in (1, 3, 40):
            names = [f"node{rng.randrange(10**6)}" for _ in range(size)]
            members = spark.createDataFrame([(n,) for n in names], "member string")
            nodes = shards.ring_nodes(members, partitions)
            owners = shards.partition_owners(nodes, partitions)
            rows = owners.collect()
            assert len(rows) == partitions
            assert {r.partition: r.member for r in rows} == _naive(names, partitions)
            covered = []
            for r in shards.ring_ranges(nodes, partitions).collect():
                covered += list(range(r.idx, r.range_end)) + list(range(r.wrap_end))
            assert sorted(covered) == list(range(partitions))
            lists = {r.member: r.partitions for r in shards.assignment_lists(members, owners).collect()}
            assert set(lists) == set(names) and sorted(sum(lists.values(), [])) == list(range(partitions))


def test_assignment_diff(spark):
    pairs = "member string, partition int"
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], pairs)
    new = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], pairs)
    got = {(r.member, r.partition): r.status for r in shards.assignment_diff(old, new).collect()}
    assert got == {("a", 0): "kept", ("a", 1): "lost", ("b", 1): "gained", ("b", 2): "kept"}


def test_partition_of_is_the_crc_of_the_uuid_bytes(spark):
    import uuid

    from pyspark.sql import functions as F

    from tickledger.functions import keys

    ids = [str(uuid.UUID(int=random.Random(i).getrandbits(128))) for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "u string")
    got = {r.u: r.p for r in df.select("u", keys.partition_of(F.col("u"), 97).alias("p")).collect()}
    assert got == {i: zlib.crc32(uuid.UUID(i).bytes) % 97 for i in ids}


def test_empty_shards_are_part_of_the_load(spark):
    owners = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], "member string, partition int")
    members = spark.createDataFrame([("a",), ("b",), ("idle",)], "member string")
    load = lambda rows: {r.member: (r["keys"], r.rows, r.skew) for r in shards.shard_load(spark.createDataFrame(rows, "domain string, timer_uuid string"), members, owners, 3).collect()}
    assert load([]) == {"a": (0, 0, None), "b": (0, 0, None), "idle": (0, 0, None)}
    some = load([("d", f"00000000-0000-0000-0000-00000000000{i % 5}") for i in range(30)])
    assert some["idle"] == (0, 0, 0.0) and sum(n for n, *_ in some.values()) == 5 and sum(n for _, n, _ in some.values()) == 30
