"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive k-grams of words the one with the smallest hash is a
fingerprint, in documents and items alike, so each window of ``WINDOW`` words that both share has
a fingerprint in common. Fingerprints that meet are extended to the windows around them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.llm import texts as X

GRAM, WINDOW = 5, 10
IN_WORD = np.ones(256, bool)
IN_WORD[:0x30] = IN_WORD[0x3A:0x61] = IN_WORD[0x7B:0x80] = False  # fixed: the byte classes of a word
BLOCK_WINDOWS = 1_000_000
RESULT = "n_words bigint, hits array<struct<begin:int,end:int>>, items array<string>"


@dataclass
class Grams:
    """Words of a slice of rows: their row, the row's first word, and hashes of any run of them."""

    row: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return X.span_hashes(self.sums, at, at + n)

    def starts(self, n: int) -> np.ndarray:
        """Where ``n`` words of one row begin."""
        last = len(self.row) - n + 1
        return np.flatnonzero(self.row[: max(last, 0)] == self.row[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the winnowed grams of rows with a whole window."""
        at = self.starts(WINDOW)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        width = WINDOW - GRAM + 1
        # a gram that would leave its row is never part of a whole window of it
        every = np.arange(len(self.row) - GRAM + 1)
        grams = np.lib.stride_tricks.sliding_window_view(self.hashes(every, GRAM), width)
        best, chosen = grams[:, 0].copy(), np.zeros(len(grams), np.int64)
        for i in range(1, width):
            less = grams[:, i] < best
            best[less], chosen[less] = grams[less, i], i
        keep = np.zeros(len(self.row), bool)
        keep[at + chosen[at]] = True
        place = np.flatnonzero(keep)
        return place, self.hashes(place, GRAM)


def grams(data: np.ndarray, starts: np.ndarray) -> Grams:
    data = X.LOWER[data]
    begin, end, row = X.words(data, starts, IN_WORD)
    own = X.span_hashes(X.prefix_sums(X.BYTE_VALUES[data]), begin, end)
    return Grams(row, np.bincount(row, minlength=len(starts) - 1), X.prefix_sums(own))


# Benchmark items as sorted tables: "fingerprints"; "windows", by length the hashes, where the items
# of each begin, and these items; "items", the ids by number. A plain dict, as it is sent to the tasks.
Block = dict


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """One row per item with its window length, the hashes of its windows and its fingerprints."""
    named = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null")

    def made(batch):
        length, windows, marks = [], [], []
        for i, j, data, starts in X.by_slice(batch.column(1)):
            g = grams(data, starts)
            first = np.concatenate([[0], np.cumsum(g.counts)])
            place, hashes = g.fingerprints()
            for k in range(j - i):
                n = min(WINDOW, int(g.counts[k]))
                at = np.arange(first[k], first[k + 1] - n + 1) if n else np.zeros(0, np.int64)
                length.append(n)
                windows.append(np.unique(g.hashes(at, n)).view(np.int64))
                own = hashes[np.searchsorted(place, first[k]) : np.searchsorted(place, first[k + 1])]
                marks.append(np.unique(own).view(np.int64))
        return [pa.array(length, pa.int32()), pa.array(windows, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))]

    return X.append(named, "length int, windows array<bigint>, marks array<bigint>", made).drop("text").where("length > 0")


def blocks(benchmark: DataFrame, item: str, text: str, block_windows: int) -> list[Block]:
    """The benchmark in blocks of about ``block_windows`` windows, each small enough to send to every task."""
    items = item_windows(benchmark, item, text)
    total = items.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_windows))
    made = []
    for k in range(n):
        table = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toArrow()
        names, ordinal = np.unique(np.array(table["item"].to_pylist(), object).astype(str), return_inverse=True)
        lengths, rows, marks = table["length"].to_numpy(), table["windows"].to_pylist(), table["marks"].to_pylist()
        windows = {}
        for length in np.unique(lengths):
            of = np.flatnonzero(lengths == length)
            sizes = [len(rows[i]) for i in of]
            value = np.array([v for i in of for v in rows[i]], np.int64).view(np.uint64)
            hashed, owner = X.distinct_pairs(np.repeat(ordinal[of], sizes), value)[::-1]
            order = np.argsort(hashed, kind="stable")
            keys, first = np.unique(hashed[order], return_index=True)
            windows[int(length)] = keys, np.append(first, len(order)), owner[order]
        prints = np.unique(np.array([v for row in marks for v in row], np.int64).view(np.uint64))
        made.append(Block(fingerprints=prints, windows=windows, items=names.tolist()))
    return made


def found(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def matches(g: Grams, block: Block) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Begins of the windows of the rows that the block has: (begins, length, entry of the table)."""
    out = []
    for length, (keys, _, _) in block["windows"].items():
        if length == WINDOW:
            place, hashes = g.fingerprints()
            place = place[found(hashes, block["fingerprints"])[0]]
            near = np.unique(place[:, None] - np.arange(WINDOW - GRAM + 1)[None, :])
            near = near[(near >= 0) & (near + WINDOW <= len(g.row))]
            at = near[g.row[near] == g.row[near + WINDOW - 1]] if len(near) else near
        else:
            at = g.starts(length)
        hit, entry = found(g.hashes(at, length), keys)
        out.append((at[hit], length, entry[hit]))
    return out


def find(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``df`` with ``n_words``, ``hits`` (maximal runs of hit words) and ``items`` (ids found, sorted as text).

    Items shorter than a window are a window of their own length. Windows are compared by 64-bit
    hashes of their words. Null and empty texts have no words and no hits; items without id or
    words are left out; repeated items count once, repeated rows are each judged. Without items
    nothing is hit. Each block of the benchmark is one more step of the same scan, so neither the
    documents nor the items are shuffled. Columns named like the results are replaced.
    """
    df = df.drop("n_words", "hits", "items")
    df = df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in (
        ("n_words", "bigint"), ("hits", "array<struct<begin:int,end:int>>"), ("items", "array<string>"))))
    column = df.columns.index(next(c for c in df.columns if c.lower() == text.lower()))
    for block in blocks(benchmark, item, item_text, block_windows):
        df = _step(df, column, df.sparkSession.sparkContext.broadcast(block))
    return df


def _step(df: DataFrame, column: int, sent) -> DataFrame:
    earlier = df.columns.index("hits")

    def made(batch):
        block, counts, spans, items = sent.value, [], [], []
        before, ids = batch.column(earlier), batch.column(earlier + 1)
        for i, j, data, starts in X.by_slice(batch.column(column)):
            g = grams(data, starts)
            counts.append(g.counts)
            first = np.concatenate([[0], np.cumsum(g.counts)])
            edge = np.zeros(len(g.row) + 1, np.int32)
            rows, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, length, entry in matches(g, block):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                _, offsets, owner = block["windows"][length]
                row, entry = X.distinct_pairs(g.row[at], entry)
                size = offsets[entry + 1] - offsets[entry]
                skip = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                rows.append(np.repeat(row, size))
                owners.append(owner[np.repeat(offsets[entry], size) + skip])
            for k in range(i, j):
                if before[k].is_valid:
                    for span in before[k].as_py():
                        edge[first[k - i] + span["begin"]] += 1
                        edge[first[k - i] + span["end"]] -= 1
            hit = np.cumsum(edge[:-1]) > 0
            begin, end, row = X.words(hit.astype(np.uint8), first, np.array([False, True]))
            spans.append((begin - first[row], end - first[row], np.bincount(row, minlength=j - i)))
            row, owner = X.distinct_pairs(np.concatenate(rows), np.concatenate(owners))
            cut = np.searchsorted(row, np.arange(j - i + 1))
            for k in range(j - i):
                own = [block["items"][o] for o in owner[cut[k] : cut[k + 1]]]
                items.append(sorted({*own, *(ids[i + k].as_py() or ())}))
        begin, end, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*spans, strict=True) if spans else ([], [], [])))
        places = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        pair = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["begin", "end"])
        return [
            pa.array(np.concatenate(counts) if counts else [], pa.int64()),
            pa.ListArray.from_arrays(places, pair),
            pa.array(items, pa.list_(pa.string())),
        ]

    return X.append(df, RESULT, made)
