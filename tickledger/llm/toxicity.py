"""Toxicity of texts: a linear classifier over character n-grams.

A feature is the presence of an n-gram. Its value is the naive Bayes log-count ratio of the n-gram
between toxic and clean texts, and logistic regression is fitted on these values. N-grams whose
ratio is within ``CERTAIN`` standard errors of zero count as zero, so that the many chance n-grams
of a long text do not add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.llm import texts as X

LENGTHS = (3, 4, 5)
BUCKETS = 1 << 18
PER_CLASS = 3000
TOXIC_FROM = 0.7
CERTAIN = 4.0


def features(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a text in lower case."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    rolled, parts = chars, [np.zeros(0, np.int32)]
    for n in range(2, max(LENGTHS) + 1):
        if len(chars) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in LENGTHS:
            parts.append((rolled * np.uint64(X.BASE) >> np.uint64(46)).astype(np.int32))
    every = np.concatenate(parts)
    seen = np.zeros(BUCKETS, bool) if len(every) > BUCKETS // 64 else None
    if seen is None:
        return np.unique(every)
    seen[every] = True
    return np.flatnonzero(seen).astype(np.int32)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(
    df: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "toxic", per_class: int = PER_CLASS,
) -> tuple[np.ndarray, float]:
    """Weights of the n-grams and the bias.

    The fit takes the ``per_class`` labelled rows of each class with the smallest hashes of their
    keys (``learn`` says of a label row whether it may be used). Their n-grams are counted in the
    tasks, and only those that count reach the driver, so neither many nor long rows fill it. Class shares are those of all usable label rows. Label rows without key or label are
    left out; of repeated ones the highest label holds. Without rows of both classes every text
    gets the share of toxic labels, or one half without labels.
    """
    own = labels if learn is None else labels.where(learn)
    own = own.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    own = own.groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).cast("int").alias("_label"))
    clean, toxic = own.agg(F.count_if(F.col("_label") == 0), F.count_if(F.col("_label") == 1)).first()
    share = (toxic + 0.5) / (clean + toxic + 1)
    if not clean or not toxic:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    chosen = [
        own.where(F.col("_label") == k).orderBy(F.xxhash64("_key"), "_key").limit(per_class).collect() for k in (0, 1)
    ]
    session = df.sparkSession
    # at most two times per_class rows of two numbers
    sample = F.broadcast(session.createDataFrame([tuple(r) for part in chosen for r in part], own.schema))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sample, "_key")

    ratio, n_clean, n_toxic = _ratios(rows)
    if not n_clean or not n_toxic:  # the sampled keys have no text
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    used = df.sparkSession.sparkContext.broadcast(ratio != 0)

    def made(batch):
        grams = [features(t.as_py()) for t in batch.column(1)]
        return [pa.array([g[used.value[g]] for g in grams], pa.list_(pa.int32()))]

    # few n-grams are left, so a row is short however long its text is
    table = X.append(rows, "_grams array<int>", made).select("_key", "_label", "_grams").toArrow().sort_by("_key")
    grams = table["_grams"].combine_chunks()
    return _fit(grams.flatten().to_numpy(), np.diff(grams.offsets.to_numpy()), table["_label"].to_numpy(), ratio, share)


def _ratios(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Log-count ratio of each n-gram, zero where it is not certain, and the number of clean and of toxic rows.

    The tasks count their own rows; at most one row of sums per bucket reaches the driver.
    """

    def counted(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)  # the last bucket counts the rows
        for batch in batches:
            for label, text in zip(batch.column("_label").to_pylist(), batch.column("_text"), strict=True):
                seen[label, features(text.as_py())] += 1  # the n-grams of a text are distinct
                seen[label, BUCKETS] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, *seen[:, at])], ["bucket", "clean", "toxic"])

    counts = rows.mapInArrow(counted, "bucket bigint, clean bigint, toxic bigint")
    table = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    for k, name in enumerate(("clean", "toxic")):
        seen[k, table["bucket"].to_numpy()] = table[name].to_numpy()
    (n_clean, n_toxic), (clean, toxic) = seen[:, BUCKETS], seen[:, :BUCKETS] + 1
    ratio = np.log(toxic / (n_toxic + 2)) - np.log(clean / (n_clean + 2))
    ratio[np.abs(ratio) < CERTAIN * np.sqrt(1 / toxic + 1 / clean)] = 0
    return ratio, int(n_clean), int(n_toxic)


def _fit(index: np.ndarray, sizes: np.ndarray, y: np.ndarray, ratio: np.ndarray, share: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both classes weigh the same
    value = ratio.astype(np.float32)[index]
    theta, bias = np.zeros(BUCKETS), 0.0
    mean, square = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(row, theta.astype(np.float32)[index] * value, len(y))
        error = (sigmoid(z) - y) * weight
        slope = np.bincount(index, error.astype(np.float32)[row] * value, BUCKETS) + 1e-4 * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta -= 0.05 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        bias -= 0.5 * error.sum()
    bias += np.log(share / (1 - share))
    return (theta * ratio).astype(np.float32), float(bias)


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "toxicity") -> DataFrame:
    """``df`` with the probability that a text is toxic; null and empty texts get that of no n-grams.

    Each row is scored alone, so repeated rows get equal scores and an empty table gives no rows.
    A column with the name of the result is replaced.
    """
    column = next(i for i, c in enumerate(df.columns) if c.lower() == text.lower())
    sent = df.sparkSession.sparkContext.broadcast(model)

    def made(batch):
        weights, bias = sent.value
        sums = [float(weights[features(t.as_py())].sum(dtype=np.float64)) for t in batch.column(column)]
        return [pa.array(sigmoid(np.array(sums) + bias), pa.float64())]

    return X.append(df, f"{name} double", made)
