"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands and stars.

Each distinct shingle falls into one of ``BANDS * ROWS`` bins by part of its hash, and a bin keeps the
smallest. An empty bin borrows from the first filled bin of a random order of its own. Documents
meet in a bucket when a band of bins agrees. In a bucket every member is first paired with one centre,
which joins most of what belongs together. Members that then still stand in different components of a bucket
meet on their rarest shingles: two close sets share one of the first few in any common order. Pairs are
confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.llm import texts as X
from tickledger.llm.components import components
from tickledger.operators.skew import split_join

BANDS, ROWS = 64, 8
BINS = BANDS * ROWS
IN_WORD = np.ones(256, bool)
IN_WORD[0x20] = IN_WORD[0x09:0x0E] = False  # fixed: the bytes between words
ORDERS = np.argsort(np.random.default_rng(8).random((BINS, BINS)), axis=1).astype(np.int16)


def shingles(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of the distinct runs of ``n`` words; a row of fewer words is one run."""
    data = X.LOWER[data]
    begin, end, row = X.words(data, starts, IN_WORD)
    sums = X.prefix_sums(X.span_hashes(X.prefix_sums(X.BYTE_VALUES[data]), begin, end))
    count = np.bincount(row, minlength=len(starts) - 1)
    first = np.cumsum(count) - count
    whole = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    at = np.concatenate([whole, first[short]])
    upto = np.concatenate([whole + n, first[short] + count[short]])
    return X.distinct_pairs(row[at], X.span_hashes(sums, at, upto))


def signatures(row: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """Smallest hash of each bin, densified; rows without shingles stay at the largest number."""
    empty = np.uint64(2**64 - 1)
    found = np.full(n_rows * BINS, empty)
    np.minimum.at(found, row * BINS + (hashes >> np.uint64(64 - 9)).astype(np.int64), X.mix(hashes))
    found = found.reshape(n_rows, BINS)
    full, some = found.copy(), (found != empty).any(axis=1)
    at, bin_ = np.nonzero((found == empty) & some[:, None])
    for k in range(BINS):
        if not len(at):
            break
        borrowed = found[at, ORDERS[bin_, k]]
        full[at, bin_] = borrowed
        still = borrowed == empty
        at, bin_ = at[still], bin_[still]
    return full


def band_hashes(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(-1, BANDS, ROWS)
    folded = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        folded = X.mix(folded * np.uint64(X.BASE) + parts[:, :, k])
    return folded


def sketches(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``id``, ``n``, fingerprints ``x`` and ``y`` of the whole set, and ``bands`` of every row."""

    def made(batch):
        sizes, x, y, bands = [], [], [], []
        for i, j, data, starts in X.by_slice(batch.column(1)):
            row, hashes = shingles(data, starts, words)
            first = np.searchsorted(row, np.arange(j - i + 1))
            sums = np.concatenate([[0], np.cumsum(hashes)]), np.concatenate([[0], np.cumsum(X.mix(hashes ^ np.uint64(X.BASE)))])
            for total, out in zip(sums, (x, y), strict=True):
                total = total.astype(np.uint64)
                out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            sizes.append(np.diff(first))
            bands.append(band_hashes(signatures(row, hashes, j - i)).view(np.int64).reshape(-1))
        joined = [np.concatenate([np.zeros(0, np.int64), *part]) for part in (sizes, x, y, bands)]
        places = pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32())
        return [*(pa.array(part, pa.int64()) for part in joined[:3]), pa.ListArray.from_arrays(places, pa.array(joined[3]))]

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return X.append(rows, "n bigint, x bigint, y bigint, bands array<bigint>", made).drop("text")


def full_sets(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``id`` and the sorted 64-bit hashes of all its shingles."""

    def made(batch):
        parts = [np.zeros(0, np.int64)]
        sizes = [np.zeros(1, np.int64)]
        for i, j, data, starts in X.by_slice(batch.column(1)):
            row, hashes = shingles(data, starts, words)
            parts.append(hashes.view(np.int64))
            sizes.append(np.bincount(row, minlength=j - i))
        places = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        return [pa.ListArray.from_arrays(places, pa.array(np.concatenate(parts)))]

    return X.append(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "grams array<bigint>", made).drop("text")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` of every row of ``df``.

    Rows are linked when 100 times the shingles they share are at least ``percent`` times those of
    both together; a component is named by the smallest key in it. Null, empty and wordless texts
    have no shingles and are linked with nothing, null keys likewise (their component is null).
    Rows with equal sets are one class, so copies are never paired; rows that share a key count as
    one document. Sets are compared by 64-bit hashes of their shingles. A pair at the threshold is
    missed with a probability of about 1e-5. Members of a bucket that are in different components
    after the stars around the smallest key are joined on their rarest shingles, which finds every
    close pair among them.
    """
    sets = X.stored(sketches(df, key, text, words), "sketches")
    classes = sets.where("n > 0 AND id IS NOT NULL").groupBy("n", "x", "y").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands")
    )
    lone = classes.select("n", "rep", F.posexplode("bands").alias("band", "hash"))
    buckets = lone.groupBy("band", "hash").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    buckets = buckets.where("low < high").select("band", "hash")
    members = X.stored(
        lone.join(buckets, ["band", "hash"]).select("band", F.xxhash64("band", "hash").alias("bucket"), "rep", "n"), "buckets"
    )
    ids = members.select(F.col("rep").alias("id")).distinct()
    kept = df.join(ids, df[key] == ids["id"], "left_semi")
    grams = X.stored(full_sets(kept, key, text, words).dropDuplicates(["id"]), "sets")
    links = X.stored(_confirmed(_star(members), grams, percent), "links")
    labels = components(links)
    rest = _candidates(_unsettled(members, labels), grams, percent)
    new = X.stored(_confirmed(rest, grams, percent), "links")
    if not new.isEmpty():
        labels = components(links.union(new))
    return _labelled(sets, classes, labels)


def _star(members: DataFrame) -> DataFrame:
    """Pairs of each member of a bucket with the bucket's smallest key."""
    centre = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.min_by("n", "rep").alias("na"))
    pairs = members.join(centre, "bucket").where("rep <> a")
    return pairs.select("a", F.col("rep").alias("b"), "na", F.col("n").alias("nb")).distinct()


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``rep``, ``n``, ``component`` of the members of buckets of several components; a star settles a bucket of two."""
    own = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    buckets = own.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count(F.lit(1)).alias("m"))
    return own.join(buckets.where("c < d AND m > 2").select("bucket"), "bucket").select("rep", "n", "component").distinct()


def _needed(n: str, m: str, percent: int) -> str:
    """SQL: how many shingles sets of ``n`` and ``m`` must share at least to be close."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _size_class(n: str) -> str:
    """SQL: number of the size class of ``n``: one for each size under 64, then 32 of equal width to each doubling."""
    over = f"(length(bin({n})) - 6)"
    return f"CASE WHEN {n} < 64 THEN {n} ELSE {over} * 32 + shiftright({n}, {over}) END"


def _smallest_of_class(c: str) -> str:
    return f"CASE WHEN {c} < 64 THEN {c} ELSE shiftleft(({c} & 31) | 32, int(shiftright({c}, 5)) - 1) END"


def _prefixes(docs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The first shingles of each set, rarest first, one row for each shingle and class of partner sizes.

    Sets of ``n`` and ``m`` that share ``k`` shingles have one of them among the first ``n - k + 1`` of the one and the
    first ``m - k + 1`` of the other, in any order that both follow. Shingles of one set only count in the order but meet nothing.
    """
    sets = X.stored(docs.join(grams.withColumnRenamed("id", "rep"), "rep"), "unsettled")
    entries = sets.select("rep", F.explode("grams").alias("gram"))
    times = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    ranked = split_join(entries, times, ["gram"], "inner").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("ranked"))
    rows = sets.drop("grams").join(ranked, "rep").withColumn("own", F.expr(_size_class("n")))
    rows = rows.withColumn("low", F.expr(f"({percent} * n + 99) div 100")).withColumn("high", F.expr(f"100 * n div {percent}"))
    rows = rows.withColumn("class", F.explode(F.sequence(F.expr(_size_class("low")), F.expr(_size_class("high")))))
    rows = rows.withColumn("low", F.expr(f"greatest(low, {_smallest_of_class('class')})")).withColumn("alone", F.expr("n - size(ranked)"))
    rows = rows.withColumn("upto", F.expr(f"n - {_needed('n', 'low', percent)} + 1 - alone")).where("upto > 0")
    rows = rows.select("rep", "component", "n", "own", "class", "alone", F.posexplode(F.expr("slice(ranked, 1, int(upto))")).alias("at", "entry"))
    return rows.select("rep", "component", "n", "own", "class", (F.col("alone") + F.col("at")).alias("at"), "entry.gram")


def _candidates(docs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle of their prefixes, early enough to be close."""
    rows = X.stored(_prefixes(docs, grams, percent), "prefixes")
    side = lambda k, m, x: (
        "gram", F.col(k).alias("k"), F.col(m).alias("m"), F.col("rep").alias(x), *(F.col(c).alias(c[0] + x) for c in ("component", "n", "at"))
    )
    left, right = rows.where("own <= class").select(*side("own", "class", "a")), rows.where("own >= class").select(*side("class", "own", "b"))
    early = f"least(na - aa, nb - ab) >= {_needed('na', 'nb', percent)}"  # what follows the first common shingle is all they can share
    pairs = left.join(right, ["gram", "k", "m"]).where(f"ca <> cb AND (k < m OR a < b) AND {early}")
    return pairs.select("a", "b", "na", "nb").distinct()


def _confirmed(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent  # else too few can be shared
    left = grams.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = grams.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.where(close).join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent).select("a", "b")


def _labelled(sets: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    rep = classes.select("n", "x", "y", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    rep = rep.withColumn("rep", F.coalesce("component", "rep"))
    rep = rep.select("n", "x", "y", F.col("rep").alias("_component"))
    rows = sets.drop("bands").join(rep, ["n", "x", "y"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return rows.select("id", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("_component")).alias("component_id"))
