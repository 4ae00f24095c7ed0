"""Exact substring deduplication by suffix sorting.

A byte goes when a ``LENGTH``-byte string that covers it also starts in a document with a smaller key.
Suffixes are compared by prefix hashes: binary search over the hashes finds how far two suffixes
agree, so a comparison takes logarithmic time, and a merge sort orders them. Equal neighbours are
verified byte by byte.

Only suffixes that can matter are sorted. Each window of ``LENGTH`` bytes belongs to an anchor, the
``GRAM`` bytes in it that hash lowest, so equal windows have equal anchors, and the same bytes before
and behind them: ``REACH`` bytes of context at least on one side. Anchors that no other document has
with that context are found by an exchange of short fingerprints. The windows of the others travel
with the few bytes around their anchor, equal surroundings once, and are sorted per anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger.llm import texts as X

LENGTH, GRAM = 50, 20
WIDTH = LENGTH - GRAM + 1  # grams of a window, and the most windows of an anchor
REACH = (LENGTH - GRAM) // 2
CHUNK_BYTES = 4 << 20
SLICE = 512 << 10
RANGE_PRINTS = 1 << 20
SORT_SUFFIXES = 1 << 20
EVERY = (1 << WIDTH) - 1


def segments(data: np.ndarray, starts: np.ndarray):
    """Runs of windows with one anchor: first window, window after the last, row, place of the anchor behind
    the first window, and its hash; then the prefix sums."""
    sums = X.prefix_sums(X.BYTE_VALUES[data])
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none.view(np.uint64), sums
    grams = X.hashes_of_length(sums, GRAM)
    bits = np.uint64(len(data).bit_length())
    lowest = grams >> bits
    lowest <<= bits
    lowest |= np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal hashes wins
    for step in (1, 2, 4, 8):
        lowest = np.minimum(lowest[:-step], lowest[step:])
    lowest = np.minimum(lowest[:n], lowest[WIDTH - 16 : WIDTH - 16 + n])
    anchor = (lowest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n, bool)
    for a, b in zip(starts[:-1], starts[1:], strict=False):
        inside[a : max(a, b - LENGTH + 1)] = True
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], n)
    begin, end = begin[inside[begin]], end[inside[begin]]
    row = np.searchsorted(starts, begin, "right") - 1
    cut = anchor[begin]
    return begin, end, row, cut - begin, X.mix(grams[cut]), sums


def contexts(begin: np.ndarray, end: np.ndarray, lead: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of anchors with ``REACH`` bytes before them or behind them, and the segment of each.

    A window has that many bytes on one side of its anchor at least, so two equal windows share such a
    context. A side that no window of a segment reaches gives none.
    """
    place = begin + lead
    left = np.flatnonzero(lead >= REACH)
    right = np.flatnonzero(place - (end - 1) <= LENGTH - GRAM - REACH)
    before = X.span_hashes(sums, place[left] - REACH, place[left] + GRAM)
    behind = X.span_hashes(sums, place[right], place[right] + LENGTH - REACH)
    return np.concatenate([before, ~behind]), np.concatenate([left, right])


class Chunk:
    """Bytes of the rows of a chunk, and the segments of those that have a key."""

    def __init__(self, table: pa.Table, key: int, text: int, with_contexts: bool = False):
        table = table.combine_chunks()
        column = table.column(text)
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        data, starts = X.joined(column)
        ids = table.column(key)
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        parts, near, count = [], [], 0
        for i, j in X.slices(starts, SLICE):
            own, places = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
            begin, end, row, lead, anchor, sums = segments(own, places)
            use = self.known[row + i]
            begin, end, row, lead, anchor = (c[use] for c in (begin, end, row, lead, anchor))
            around = X.span_hashes(sums, begin, end + LENGTH - 1)
            parts.append((begin + starts[i], end + starts[i], row + i, lead, anchor, around))
            if with_contexts:
                context, segment = contexts(begin, end, lead, sums)
                near.append((context, segment + count))
            count += len(begin)
        self.data, self.starts, self.table = data, starts, table
        empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.begin, self.end, self.row, self.lead, self.anchor, self.around = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else empty
        self.context, self.segment = (np.concatenate(c) for c in zip(*near, strict=True)) if near else (empty[4], empty[0])

    def prints(self, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each distinct context by range and short fingerprint, its range, and whether two rows here have it."""
        order = np.argsort(self.context)
        context, row = self.context[order], self.row[self.segment[order]]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), context[1:] != context[:-1]]))
        if not len(first):
            return context, first, first.astype(bool)
        context, several = context[first], np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
        of = (context % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
        order = np.argsort(of, kind="stable")
        return context[order], of[order].astype(np.int64), several[order]


def _fingerprints(key: int, text: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("_chunk")[0].as_py()
        context, of, _ = Chunk(table, key, text, True).prints(ranges)
        short = (context >> np.uint64(32)).astype(np.uint32)
        cut = np.searchsorted(of, np.arange(ranges + 1))
        used = [r for r in range(ranges) if cut[r] < cut[r + 1]]
        blobs = [short[cut[r] : cut[r + 1]].tobytes() for r in used]
        return pa.table({
            "_range": pa.array(used, pa.int32()), "_chunk": pa.array([chunk] * len(used), pa.int64()), "prints": pa.array(blobs, pa.binary()),
        })

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Which fingerprints of each chunk another chunk has too."""
    rows = [np.frombuffer(b.as_py(), np.uint32) for b in table.column("prints")]
    every = np.concatenate(rows)
    distinct = [np.unique(r) for r in rows]
    value, count = np.unique(np.concatenate(distinct), return_counts=True)
    value = value[count > 1]
    shared = np.isin(every, value)
    cut = np.cumsum([0, *map(len, rows)])
    masks = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
    return pa.table({"_chunk": table.column("_chunk"), "_range": table.column("_range"), "shared": pa.array(masks, pa.binary())})


def _surroundings(key: int, text: int, ranges: int):
    """Surroundings of the anchors whose context another document has too, each once per chunk.

    Their bytes go with the chunk, the smallest key in it and how far the largest is from it. Half of the hash of
    the anchor is enough to bring equal ones together, and the numbers are small, so that they take little room.
    """

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        columns, around = [np.zeros(0, np.int64)] * 4, pa.array([], pa.binary())
        anchor = np.zeros(0, np.uint32)
        if table.num_rows:
            chunk = Chunk(table, key, text, True)
            context, of, several = chunk.prints(ranges)
            cut = np.searchsorted(of, np.arange(ranges + 1))
            for r, mask in zip(replies.column("_range").to_pylist(), replies.column("shared").to_pylist(), strict=True):
                size = cut[r + 1] - cut[r]
                several[cut[r] : cut[r + 1]] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=size).astype(bool)
            candidate = np.zeros(len(chunk.begin), bool)
            candidate[chunk.segment[np.isin(chunk.context, context[several])]] = True
            hit = np.flatnonzero(candidate)
            ids = chunk.ids[chunk.row[hit]]
            order = np.lexsort((ids, chunk.around[hit]))
            at, ids = hit[order], ids[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), np.diff(chunk.around[at].view(np.int64)) != 0]))
            last = np.append(first[1:], len(at)) - 1 if len(at) else first
            low, high, at = ids[first], ids[last], at[first]
            begin, end = chunk.begin[at], chunk.end[at] + LENGTH - 1
            size = end - begin
            flat = chunk.data[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]
            places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            around = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(flat.tobytes())])
            number = table.column("_chunk")[0].as_py()
            columns = [np.full(len(at), number), chunk.lead[at], low, high - low]  # a difference may wrap, and wraps back
            anchor = (chunk.anchor[at] >> np.uint64(32)).astype(np.uint32)
        columns = [pa.array(c, pa.int64()) for c in columns]
        return pa.table([pa.array(anchor.view(np.int32)), *columns, around], ["anchor", "_chunk", "lead", "low", "more", "bytes"])

    return run


def common(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first ``LENGTH`` bytes two suffixes share, by binary search over prefix hashes."""
    _, down = X.powers(len(sums))
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (sums[a + middle] - sums[a]) * down[a] == (sums[b + middle] - sums[b]) * down[b]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def less(data: np.ndarray, sums: np.ndarray, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Whether suffix ``a`` comes before ``b``; equal ones where ``ties`` says so."""
    same = common(sums, a, b)
    inner = same < LENGTH
    at = np.where(inner, same, 0)
    return np.where(inner, data[a + at] < data[b + at], ties)


def merge_sort(data: np.ndarray, sums: np.ndarray, suffix: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """``suffix`` sorted inside each run of equal ``bucket``; all buckets are merged level by level at once."""
    suffix = suffix.copy()
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(edge, len(suffix)))
    width = 1
    while len(active := np.flatnonzero(sizes > width)):
        base, size = np.repeat(edge[active], sizes[active]), np.repeat(sizes[active], sizes[active])
        inner = np.arange(len(base)) - np.repeat(np.cumsum(sizes[active]) - sizes[active], sizes[active])
        run = inner // width
        low = np.minimum((run ^ 1) * width, size)
        begin, high = low.copy(), np.minimum(low + width, size)
        own = suffix[base + inner]
        right = run % 2 == 1
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            other = suffix[base[open_] + middle]
            # a right run's element goes behind equal ones of the left run
            before = less(data, sums, other, own[open_], right[open_])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        target = base + (run & ~1) * width + (inner - run * width) + (low - begin)
        suffix[target] = own
        width *= 2
    return suffix


def first_documents(data: np.ndarray, starts: np.ndarray, lead: np.ndarray, anchor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bit i of a surrounding: its i-th window also starts in a document smaller than its first one."""
    windows = np.diff(starts) - LENGTH + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = starts[owner] + number
    relative = number - lead[owner]
    order = np.lexsort((relative, anchor[owner]))
    bucket = np.cumsum(np.concatenate([[False], (np.diff(relative[order]) != 0) | (np.diff(anchor[owner][order].view(np.int64)) != 0)]))
    sums = X.prefix_sums(X.BYTE_VALUES[data])
    placed = merge_sort(data, sums, suffix[order], bucket)
    by_suffix = np.empty(len(data), np.int64)
    by_suffix[suffix] = np.arange(len(suffix))
    who = by_suffix[placed]
    equal = np.zeros(len(placed), bool)
    same_bucket = np.flatnonzero(bucket[1:] == bucket[:-1]) + 1
    equal[same_bucket] = common(sums, placed[same_bucket - 1], placed[same_bucket]) == LENGTH
    claimed = np.flatnonzero(equal)
    for at in range(0, len(claimed), 1 << 16):  # a hash may collide; bytes decide
        part = claimed[at : at + (1 << 16)]
        offsets = np.arange(LENGTH)
        true = (data[placed[part - 1][:, None] + offsets] == data[placed[part][:, None] + offsets]).all(axis=1)
        equal[part[~true]] = False
    group = np.flatnonzero(~equal)
    smallest = np.minimum.reduceat(first[owner[who]], group) if len(group) else first[:0]
    smallest = np.repeat(smallest, np.diff(np.append(group, len(placed))))
    masks = np.zeros(len(windows), np.int64)
    taken = smallest < first[owner[who]]
    np.bitwise_or.at(masks, owner[who][taken], np.int64(1) << number[who][taken])
    return masks


def _sorted_masks(batches):
    """Streams surroundings in anchor order and sorts them, whole anchors at a time; each chunk is told about its own."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        if not table.num_rows:
            return None
        data, starts = X.joined(table.column("bytes").chunk(0))
        around = X.span_hashes(X.prefix_sums(X.BYTE_VALUES[data]), starts[:-1], starts[1:]).view(np.int64)
        # equal surroundings of several chunks are one
        order = np.argsort(around, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(around[order]) != 0]))
        low, more = table.column("low").to_numpy(), table.column("more").to_numpy()
        first = np.minimum.reduceat(low[order], edge)
        last = np.maximum.reduceat((low + more)[order], edge)
        at, group = order[edge], np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
        own, size = around, np.diff(starts)[at]
        data = data[np.arange(size.sum()) + np.repeat(starts[at] - (np.cumsum(size) - size), size)]
        starts = np.concatenate([[0], np.cumsum(size)])
        masks = first_documents(data, starts, table.column("lead").to_numpy()[at], table.column("anchor").to_numpy()[at].astype(np.int64), first)
        use = ((masks != 0) | (last > first))[group]  # others change nothing
        columns = table.column("_chunk").to_numpy(), own, first[group], masks[group]
        return pa.RecordBatch.from_arrays([pa.array(c[use]) for c in columns], ["_chunk", "around", "first", "mask"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size * WIDTH // 2 >= SORT_SUFFIXES:
            anchor = batch.column(batch.schema.names.index("anchor")).to_numpy()
            last = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
            if last:
                yield work([*held[:-1], batch.slice(0, last)])
                held = [batch.slice(last)]
                size = batch.num_rows - last
    if held and (made := work(held)) is not None:
        yield made


def _cut(key: int, text: int, names: list[str]):
    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        chunk = Chunk(table, key, text)
        table = chunk.table
        edge = np.zeros(len(chunk.data) + 1, np.int32)
        if marks.num_rows:
            sign = marks.column("around").to_numpy().view(np.uint64)
            order = np.argsort(sign)
            sign, mask = sign[order], marks.column("mask").to_numpy()[order]
            first = marks.column("first").to_numpy()[order]
            at = np.minimum(np.searchsorted(sign, chunk.around), len(sign) - 1)
            hit = sign[at] == chunk.around
            at = at[hit]
            begin, size = chunk.begin[hit], (chunk.end - chunk.begin)[hit]
            mask = np.where(chunk.ids[chunk.row[hit]] > first[at], EVERY, mask[at])
            window = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            taken = np.repeat(mask, size) >> window & 1 == 1
            window = (np.repeat(begin, size) + window)[taken]
            np.add.at(edge, window, 1)
            np.add.at(edge, window + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begin, end, row = X.words(gone.view(np.uint8), chunk.starts, np.array([False, True]))
        pair = pa.StructArray.from_arrays(
            [pa.array(begin - chunk.starts[row], pa.int32()), pa.array(end - chunk.starts[row], pa.int32())], ["begin", "end"]
        )
        rows = len(chunk.starts) - 1
        places = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
        spans = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pair)
        before = np.concatenate([[0], np.cumsum(~gone)])[chunk.starts].astype(np.int32)
        left = pa.BinaryArray.from_buffers(
            pa.binary(), rows, [None, pa.py_buffer(before.tobytes()), pa.py_buffer(chunk.data[~gone].tobytes())]
        )
        return pa.table([*(table.column(n) for n in range(len(names))), spans, left], [*names, "removed", "kept"])

    return run


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``removed`` (maximal byte runs that go) and ``kept`` (the other bytes, joined).

    Texts are UTF-8 bytes and are judged as they come in. Null and empty texts, texts shorter than
    ``LENGTH`` bytes and rows with a null key lose nothing, and a null key is never the smaller one.
    Rows that share a key do not touch each other. Columns named like the results are replaced, any
    other name is free. An empty table gives no rows. Chunks hold about ``CHUNK_BYTES`` of whole rows, the sort about
    ``SORT_SUFFIXES`` suffixes and always whole anchors: of a passage that very many documents share,
    the anchors at its two ends have one surrounding per document, all others at most one per chunk.
    """
    df, named = X.shielded(df.drop("removed", "kept"), key=key, text=text)
    key, text = "own_key", "own_text"
    names = df.columns
    at, content = names.index(key), names.index(text)
    session = df.sparkSession
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // CHUNK_BYTES))
    ranges = max(1, -(-total // 11 // RANGE_PRINTS))
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), min(chunks, 100_000))
    rows = df.withColumn("_chunk", F.pmod(F.xxhash64(key, text), F.lit(chunks)).cast("long")).repartition(parts, "_chunk")

    prints = rows.groupBy("_chunk").applyInArrow(_fingerprints(at, content, ranges), "_range int, _chunk bigint, prints binary")
    replies = prints.groupBy("_range").applyInArrow(_repeated, "_chunk bigint, _range int, shared binary")
    both = rows.groupBy("_chunk").cogroup(replies.groupBy("_chunk"))
    found = both.applyInArrow(
        _surroundings(at, content, ranges), "anchor int, _chunk bigint, lead bigint, low bigint, more bigint, bytes binary"
    )
    marks = found.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(
        _sorted_masks, "_chunk bigint, around bigint, first bigint, mask bigint"
    )
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("removed array<struct<begin:int,end:int>>, kept binary").fields])
    return named(rows.groupBy("_chunk").cogroup(marks.groupBy("_chunk")).applyInArrow(_cut(at, content, names), schema))


def whole_characters(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the text ``name`` of the bytes in ``column``, without bytes that are no UTF-8; null gives empty."""
    at = df.columns.index(column)

    def made(batch):
        return [pa.array([(b.as_py() or b"").decode("utf-8", "ignore") for b in batch.column(at)], pa.string())]

    return X.append(df, f"{name} string", made)
