"""Removal of word passages that an earlier document has, by seed and extend.

Each window of ``length`` words has an anchor: the leftmost of its grams with the smallest hash.
Equal windows have equal anchors, so documents that share a window meet at it. Neighbouring windows
with the same anchor are one seed; its context is all their words. A hit of an anchor is extended
in two steps: seeds of equal context match as a whole and are reduced to their first document, and
of the other contexts of the anchor one seed each is extended window by window, to the left as far
as to the right is missing. No two documents are paired: a group of any size costs its rows, and
each context its windows once. Touching windows that are found make up the maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger.llm import texts as X
from tickledger.operators.skew import split_join

LENGTH, GRAM = 50, 20
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False  # fixed: the bytes between words
LAST_ID = (1 << 63) - 1


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` neighbours, from spans of doubled size."""
    best, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        less = best[step:] < best[:-step]
        place = np.where(less, place[step:], place[:-step])
        best = np.where(less, best[step:], best[:-step])
        size += step
    return place


class Passages:
    """Words of a slice of rows and their seeds: first window, number of windows, anchor and context."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, gram: int):
        self.data, self.starts, self.length = data, starts, length
        self.begin, self.end, self.row = X.words(data, starts, IN_WORD)
        self.counts = np.bincount(self.row, minlength=len(starts) - 1)
        own = X.span_hashes(X.prefix_sums(X.BYTE_VALUES[data]), self.begin, self.end)
        self.sums = X.prefix_sums(own)
        n = len(self.row)
        window = np.flatnonzero(self.row[: max(n - length + 1, 0)] == self.row[length - 1 :])
        every = np.arange(n - gram + 1) if len(window) else window
        grams = X.span_hashes(self.sums, every, every + gram)
        place = leftmost_minima(grams, length - gram + 1)[window] if len(window) else window
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        self.low, self.size = window[first], np.diff(np.append(first, len(window)))
        self.anchor = grams[place[first]].view(np.int64)
        context = X.span_hashes(self.sums, self.low, self.low + self.size + (length - 1))
        self.context = X.mix(context + (place[first] - self.low).astype(np.uint64)).view(np.int64)

    def windows(self, seeds: np.ndarray) -> np.ndarray:
        """First words of the windows of some seeds."""
        size = self.size[seeds]
        return np.repeat(self.low[seeds] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def hashes(self, window: np.ndarray) -> np.ndarray:
        return X.span_hashes(self.sums, window, window + self.length).view(np.int64)

    def removed(self, mark: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which words are in a marked window; ``mark`` belongs to row ``of``, both in order of the rows."""
        edge = np.zeros(len(self.row) + 1, np.int32)
        whole = listed(self.context, self.row[self.low], mark, of)
        some = self.windows(np.flatnonzero(~whole & np.isin(self.row[self.low], of)))
        some = some[listed(self.hashes(some), self.row[some], mark, of)]
        for low, size in ((self.low[whole], self.size[whole]), (some, np.ones(len(some), np.int64))):
            np.add.at(edge, low, 1)
            np.add.at(edge, low + size + (self.length - 1), -1)
        return np.cumsum(edge[:-1]) > 0

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each row with one space between them: bytes and where each row starts."""
        begin, end, row = self.begin[keep], self.end[keep], self.row[keep]
        size = end - begin + 1
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out = np.append(self.data, np.uint8(32))[at]
        space = np.cumsum(size) - 1
        out[space] = 32
        last = np.ones(len(row), bool)
        last[:-1] = row[:-1] != row[1:]
        stay = np.ones(len(out), bool)
        stay[space[last]] = False
        per_row = np.bincount(row, size - last, minlength=len(self.starts) - 1).astype(np.int64)
        return out[stay], np.concatenate([[0], np.cumsum(per_row)])


def listed(value: np.ndarray, row: np.ndarray, mark: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether (row, value) is among (of, mark)."""
    pair = lambda v, r: X.mix(v.view(np.uint64)) + r.astype(np.uint64)
    table = np.sort(pair(mark, of))
    if not len(table):
        return np.zeros(len(value), bool)
    wanted = pair(value, row)
    return table[np.minimum(np.searchsorted(table, wanted), len(table) - 1)] == wanted


def _lists(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of rows ``i`` to ``j`` of a list column and the row of each, counted from ``i``."""
    part = column.slice(i, j - i)
    size = part.value_lengths().fill_null(0).to_numpy()
    return part.flatten().to_numpy(), np.repeat(np.arange(j - i), size)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _seeds(length: int, gram: int):
    """(anchor, context, doc, row_key) of each seed, once per row."""

    def run(batches):
        for batch in batches:
            doc, key = batch.column("doc").to_numpy(), batch.column("row_key").to_numpy()
            for i, j, data, starts in X.by_slice(batch.column("text")):
                p = Passages(data, starts, length, gram)
                row = p.row[p.low]
                order = np.lexsort((p.context, row))
                keep = np.ones(len(order), bool)
                keep[1:] = (np.diff(p.context[order]) != 0) | (np.diff(row[order]) != 0)
                use = order[keep]
                yield _batch([p.anchor[use], p.context[use], doc[i:j][row[use]], key[i:j][row[use]]], ["anchor", "context", "doc", "row_key"])

    return run


def _windows(length: int, gram: int):
    """(mark, doc, row_key) of each window of the seeds in ``wanted``, once per row."""

    def run(batches):
        for batch in batches:
            doc, key, wanted = (batch.column(c) for c in ("doc", "row_key", "wanted"))
            doc, key = doc.to_numpy(), key.to_numpy()
            for i, j, data, starts in X.by_slice(batch.column("text")):
                p = Passages(data, starts, length, gram)
                window = p.windows(np.flatnonzero(listed(p.context, p.row[p.low], *_lists(wanted, i, j))))
                row, mark = X.distinct_pairs(p.row[window], p.hashes(window))
                yield _batch([mark, doc[i:j][row], key[i:j][row]], ["mark", "doc", "row_key"])

    return run


def _cut(length: int, gram: int, names: list[str]):
    def run(batches):
        for batch in batches:
            marks, others = batch.column("marks"), batch.column("others")
            for i, j, data, starts in X.by_slice(batch.column("text")):
                p = Passages(data, starts, length, gram)
                gone = p.removed(*_lists(marks, i, j))
                first = np.concatenate([[0], np.cumsum(p.counts)])
                begin, end, row = X.words(gone.view(np.uint8), first, np.array([False, True]))
                pair = pa.StructArray.from_arrays([pa.array(begin - first[row], pa.int32()), pa.array(end - first[row], pa.int32())], ["begin", "end"])
                places = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                kept, at = p.joined(~gone)
                kept = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [others.slice(i, j - i), batch.column("text").slice(i, j - i), pa.array(p.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pair), kept],
                    names,
                )

    return run


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``df`` with ``n_words``, ``removed`` (maximal runs of word numbers that go) and ``kept`` (the other words, one space between).

    A word goes if one of the windows of ``length`` words around it also starts in a row with a
    smaller ``key``; windows are judged as they come in. Words are runs of anything but ASCII white
    space and are compared unchanged, by 64-bit hashes. Null and empty texts have no words, shorter
    texts lose nothing. A null key is never the smaller one, rows that share a key do not touch each
    other, and equal rows lose the same. Columns named like the results are replaced, all others
    stay under any name. An empty table gives no rows.
    """
    spark = df.sparkSession
    df = df.drop("n_words", "removed", "kept")
    others = [c for c in df.columns if c != text]
    ident = F.col(f"`{key}`").cast("bigint")
    content = F.col(f"`{text}`")
    docs = df.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"),
        F.coalesce(ident, F.lit(LAST_ID)).alias("doc"), F.xxhash64(ident, content).alias("row_key"), content.alias("text"),
    )
    scanned = docs.select("doc", "row_key", "text")
    seeds = scanned.mapInArrow(_seeds(length, gram), "anchor bigint, context bigint, doc bigint, row_key bigint")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("context", "doc") for f in (F.min, F.max)]
    anchors = seeds.groupBy("anchor").agg(*ends).where("min_context < max_context or min_doc < max_doc")
    anchors = anchors.select("anchor", (F.col("min_context") < F.col("max_context")).alias("several"), F.col("min_doc").alias("first"))
    # one context: the first document of the anchor is that of the context
    met = X.stored(split_join(seeds, anchors, ["anchor"], "inner").where("several or doc > first"), "seeds")
    sure = met.where("not several").select("row_key", F.col("context").alias("mark"))
    open_seeds = met.where("several").select("context", "doc", "row_key")
    firsts = open_seeds.groupBy("context").agg(F.min("doc").alias("first"))
    judged = X.stored(split_join(open_seeds, firsts, ["context"], "inner").select("row_key", F.col("context").alias("mark"), (F.col("doc") > F.col("first")).alias("later")), "contexts")

    wanted = judged.where("not later").groupBy("row_key").agg(F.collect_set("mark").alias("wanted"))
    windows = docs.join(wanted, "row_key").mapInArrow(_windows(length, gram), "mark bigint, doc bigint, row_key bigint")
    earliest = windows.groupBy("mark").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    found = split_join(windows, earliest, ["mark"], "inner").where("doc > first").select("row_key", "mark")
    marks = sure.unionByName(judged.where("later").select("row_key", "mark")).unionByName(found)
    marks = marks.groupBy("row_key").agg(F.collect_set("mark").alias("marks"))

    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([
        T.StructField("others", T.StructType([fields[c] for c in others])), T.StructField("text", T.StringType()),
        *T._parse_datatype_string("n_words bigint, removed array<struct<begin:int,end:int>>, kept string").fields,
    ])
    rows = docs.join(marks, "row_key", "left").mapInArrow(_cut(length, gram, schema.names), schema)
    columns = [F.col("text").alias(c) if c == text else F.col("others")[c].alias(c) for c in df.columns]
    return rows.select(*columns, "n_words", "removed", "kept")
