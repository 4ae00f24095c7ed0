"""Exact top-k search by inner product with KD-trees per shard.

Every shard is a task that builds a tree (median splits, tight boxes) and then streams the queries
through it. A tree is searched best first by the largest product its boxes allow; a box below the
k-th best score so far is left out. A first pass over one shard gives each query a k-th score, which
the pass over all shards starts from. Pairs with a vector whose products a long might not hold are scored
apart, in whole numbers of any size.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

LEAF = 256
SHARD_ROWS = 16_384
LARGEST = 2.0**27


def vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id``, ``dims``, ``x``, ``y``, ``wide``: vectors that can take part, scaled and rounded down in ``y``.

    Left out: null keys and vectors, null or non-finite components. ``wide`` ones have a component beyond
    2**27, or so many large ones that a long might not hold their products.
    """
    x = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("dims", F.size("x"))
    most = F.least(F.lit(LARGEST), F.sqrt(F.lit(2.0**62) / F.greatest("dims", F.lit(1))))
    # floor of a double is a long; beyond 2**53 a double is whole
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return rows.select(
        "id", "dims", "x", F.transform("x", lambda x: whole(x * scale)).alias("y"), F.exists("x", lambda x: F.abs(x * scale) > most).alias("wide")
    )


def narrow(rows: DataFrame) -> DataFrame:
    return rows.where("NOT wide").select("id", "dims", F.transform("y", lambda y: y.cast("bigint")).alias("v"))


class Tree:
    """Boxes of a KD-tree over the rows of ``points``; ``children`` of a leaf are (-1, -1)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        low, high, span, children = [], [], [], []

        def build(begin: int, end: int) -> int:
            node = len(span)
            own = points[order[begin:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            span.append((begin, end))
            children.append((-1, -1))
            if end - begin > LEAF:
                middle = (begin + end) // 2
                widest = int((high[node] - low[node]).argmax())
                order[begin:end] = order[begin:end][np.argpartition(own[:, widest], middle - begin)]
                children[node] = build(begin, middle), build(middle, end)
            return node

        build(0, len(ids))
        self.low, self.high, self.span, self.children = np.array(low), np.array(high), span, children
        self.ids, self.points = ids[order], points[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and box, the largest inner product with a point of the box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best points, leaving out id ``own`` and scores below ``least``."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < least:
                break
            if self.children[node][0] >= 0:
                for child in self.children[node]:
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            begin, end = self.span[node]
            found = self.points[begin:end] @ query
            use = (found >= least) & (self.ids[begin:end] != own)
            if use.any():
                ids, scores = np.append(ids, self.ids[begin:end][use]), np.append(scores, found[use])
                if len(ids) >= k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    least = max(least, scores[-1])
        return ids, scores


def _search(rows: DataFrame, k: int) -> DataFrame:
    """Per shard: rows of its candidates (``query`` false) come first, then its queries."""

    def run(batches):
        shard, held, tree = None, [], None
        for batch in batches:
            places = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            ids, least = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            dims = batch.column(4)[0].as_py() if batch.num_rows else 0
            edges = [0, *(np.flatnonzero((places[1:] != places[:-1]) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if places[i] != shard:
                    shard, held, tree = places[i], [], None
                part = batch.column(5).slice(i, j - i)
                dims = len(part[0])
                points = part.flatten().to_numpy().astype(np.int64).reshape(j - i, dims)
                if not asks[i]:
                    held.append((ids[i:j], points))
                    continue
                if tree is None:
                    if not held:
                        continue
                    every = np.concatenate([p for _, p in held])
                    top = max(abs(int(every.min(initial=0))), abs(int(every.max(initial=0))))
                    exact = np.float64 if dims * max(top, 1) * LARGEST < 2**53 else np.int64
                    tree = Tree(np.concatenate([x for x, _ in held]), every.astype(exact))
                    held = []
                out = [[], [], []]
                for a in range(i, j, 256):
                    b = min(a + 256, j)
                    asked = points[a - i : b - i].astype(tree.points.dtype)
                    bounds = tree.bounds(asked)
                    for x in range(a, b):
                        found, scores = tree.search(ids[x], asked[x - a], bounds[x - a], k, least[x])
                        out[0].append(np.full(len(found), ids[x]))
                        out[1].append(found)
                        out[2].append(scores.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["query_id", "vec_id", "score"]
                )

    rows = rows.select("_shard", "_query", "id", "_least", "dims", "v")
    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def whole_numbers(vector: list[float], scale: float) -> list[int]:
    """Components times ``scale``, rounded down, of any size."""
    return [math.floor(y) if math.isfinite(y := x * scale) else math.floor(Fraction(x) * Fraction(scale)) for x in vector]


def sortable(n: int) -> bytes:
    """Bytes in the order of the numbers."""
    size = (abs(n).bit_length() + 7) // 8
    body = size.to_bytes(2, "big") + abs(n).to_bytes(size, "big")
    return b"\1" + body if n >= 0 else b"\0" + bytes(255 - x for x in body)


def _search_wide(rows: DataFrame, k: int, scale: float) -> DataFrame:
    """The k best pairs of each query in a shard, of those with a wide vector; ``over`` orders scores beyond a long."""

    def run(batches):
        shard, held = None, []
        for batch in batches:
            out = []
            for place, asks, id_, wide, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != shard:
                    shard, held = place, []
                own = whole_numbers(x, scale)
                if not asks:
                    held.append((id_, wide, own))
                    continue
                found = ((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, w, v in held if (w or wide) and i != id_)
                out += [(id_, i, -score) for score, i in heapq.nsmallest(k, found)]
            scores = [n for _, _, n in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, _, _ in out], pa.int64()), pa.array([i for _, i, _ in out], pa.int64()),
                    pa.array([min(max(n, -(2**63)), 2**63 - 1) for n in scores], pa.int64()),
                    pa.array([None if -(2**63) < n < 2**63 - 1 else sortable(n) for n in scores], pa.binary()),
                ],
                ["query_id", "vec_id", "score", "over"],
            )

    rows = rows.select("_shard", "_query", "id", "wide", "x").repartition("_shard").sortWithinPartitions("_shard", "_query")
    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, over binary")


def top_k(
    df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best candidates of each query row.

    The score is the inner product of the components times ``scale``, rounded down; ties go to the
    smaller id. Candidates are the rows of other ids with as many components; all if fewer than k.
    A query id counts once, with its smallest vector; repeated candidates are each a row. For
    vectors that take no part see ``vectors``. A score that a long cannot hold is ranked by its true value
    and written as the long's end. No usable query gives no rows. Each query travels to
    every shard, candidates travel once for each pass; a shard holds about ``shard_rows`` of them.
    """
    every = vectors(df, key, vector, scale)
    counted = every.groupBy("dims", "wide").count().collect()  # at most two rows per vector length
    empty = df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not counted:
        return empty
    any_wide = any(r["wide"] for r in counted)
    sizes = {}
    for r in counted:
        sizes[r["dims"]] = sizes.get(r["dims"], 0) + r["count"]
    shards = max(-(-n // shard_rows) for n in sizes.values())
    rows = narrow(every)
    home = F.struct(F.col("dims"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("n"))
    candidates = rows.select(F.xxhash64(home).alias("_shard"), F.lit(False).alias("_query"), F.lit(None).cast("double").alias("_least"), "id", "dims", "v")
    queries = vectors(df.where(is_query), key, vector, scale)
    if any_wide:
        queries = queries.groupBy("id").agg(F.min(F.struct("dims", "y", "x", "wide")).alias("q")).select("id", "q.*")
        asked = narrow(queries)
    else:
        asked = narrow(queries).groupBy("id").agg(F.min(F.struct("dims", "v")).alias("q")).select("id", "q.dims", "q.v")

    def searched(queries: DataFrame) -> DataFrame:
        both = candidates.unionByName(queries.withColumn("_query", F.lit(True)))
        return _search(both.repartition("_shard").sortWithinPartitions("_shard", "_query"), k)

    first = asked.withColumn("_shard", F.xxhash64(home)).withColumn("_least", F.lit(float("-inf")))
    least = searched(first).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("s"))
    least = least.where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("s").alias("_least"))
    places = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda n: F.xxhash64(F.struct(F.col("dims"), n.cast("bigint").alias("n"))))
    asked = asked.join(least, "id", "left").fillna(float("-inf"), "_least").withColumn("_shard", F.explode(places))
    found, order = searched(asked), [F.desc("score"), F.col("vec_id")]
    if any_wide:
        mine = F.xxhash64(F.struct(F.col("dims"), F.pmod(F.xxhash64("id", "y"), F.lit(shards)).alias("n")))
        both = every.withColumn("_shard", mine).withColumn("_query", F.lit(False))
        both = both.unionByName(queries.withColumn("_shard", F.explode(places)).withColumn("_query", F.lit(True)))
        found = found.withColumn("over", F.lit(None).cast("binary")).unionByName(_search_wide(both, k, scale))
        order.insert(1, F.desc("over"))
    window = W.Window.partitionBy("query_id").orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
