"""Sharding by a two-pass external shuffle.

Pass one scatters the rows over memory-sized buckets by a seeded hash (one Spark exchange, which
is the external part). Pass two shuffles each bucket with Fisher-Yates. The buckets laid end to end
are a random order of all rows, and the shards are equal cuts of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tickledger.llm import texts as X

LAW = "rows"


def text_bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def shards(
    df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 1, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (from 0, gapless).

    Law ``rows``: the row counts of two shards differ by one at most. A row's bucket depends on the
    seed, its key and its text; the order is the same in every run on the same rows. Null keys and
    texts hash like a value of their own. Repeated rows share a bucket and are all kept; a bucket
    that they make too large is sorted on disk by Spark, and pass two holds one number per row of
    it. An empty table gives no rows. Columns named ``shard`` or ``slot`` are replaced, any other
    name is free.
    """
    df, named = X.shielded(df.drop("shard", "slot"), key=key, text=text)
    key, text = "own_key", "own_text"
    content = F.crc32(text_bytes(text))
    size = F.octet_length(text_bytes(text)).cast("long") + 1
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    drawn = [F.xxhash64(F.lit(f"{seed}/{use}"), F.col(key), content) for use in ("bucket", "order")]
    rows = df.select(
        "*", F.pmod(drawn[0], F.lit(buckets)).alias("_bucket"), drawn[1].alias("_drawn")
    )
    # one row for each bucket_bytes of input; the running sum needs them in one place
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the join keeps the partitions of the scatter, so the texts move once
    scattered = rows.repartition(max(parts, min(buckets, 100_000)), "_bucket").join(sizes, "_bucket")
    scattered = scattered.sortWithinPartitions("_bucket", "_drawn", key)
    placed = _fisher_yates(scattered, seed)
    numbered = placed.withColumn("shard", F.expr(f"cast(_rank * {n_shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return named(numbered.withColumn("slot", F.col("_rank") - first).drop("_bucket", "_drawn", "_rows", "_before", "_rank"))


def _fisher_yates(scattered: DataFrame, seed: int) -> DataFrame:
    """``_rank``: rows before the bucket plus the place that the bucket's shuffle gives the row."""
    names = scattered.columns
    at, size, before = (names.index(c) for c in ("_bucket", "_rows", "_before"))
    schema = T.StructType([*scattered.schema.fields, T.StructField("_rank", T.LongType())])

    def run(batches):
        bucket, places, used = None, None, 0
        for batch in batches:
            ids, rank = batch.column(at).to_numpy(), np.empty(batch.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if ids[i] != bucket:
                    bucket, used = ids[i], 0
                    places = np.random.default_rng([seed, bucket]).permutation(batch.column(size)[i].as_py())
                rank[i:j] = places[used : used + j - i] + batch.column(before)[i].as_py()
                used += j - i
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*names, "_rank"])

    return scattered.mapInArrow(run, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; inside it the rows stand in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
