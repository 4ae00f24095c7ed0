"""Language-model scores by logistic context mixing.

A text is its words in lower case, each followed by a space, and an end symbol. A symbol is coded as
bits along a prefix code of the symbol before it. Hashed contexts (2, 3 and 5 symbols, and the word so far) each predict
every bit from counts of the training texts; the predictions are added in the logistic domain with
weights that a gate chooses (the longest context seen before), and the weights go on learning
inside each document, block by block. The sum of the costs is the text's total bits.

What a symbol's bits are predicted from is the same wherever it follows the same contexts, so each slice of
texts looks it up once and counts how often it stands there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.llm import texts as X
from tickledger.llm.near_duplicates import IN_WORD

ORDERS = (2, 3, 5)
PREDICTORS = len(ORDERS) + 1
GATES = PREDICTORS + 1
PAD = max(ORDERS)
END, BEFORE = 256, 257
BLOCK = 512
RATE = 1.0
BLOCK_SLOTS = 4096
LARGEST_BITS = 22
SENT_BLOCKS = 64
SAMPLE = 256
FREQUENT = 200_000
SLICE = 512 << 10
LEARN_SLICE = 768 << 10
PART = 1 << 16
SCALE = np.array([1 / 16] * PREDICTORS + [0.3])
PART_BITS = 1 << 13  # products of this size stay in one thread
SYMBOLS = np.where(IN_WORD, X.LOWER, 32).astype(np.int64)
TOKEN_VALUES = np.append(X.BYTE_VALUES, np.zeros(2, np.uint64))
VALUES = (X.mix(np.arange(BEFORE + 1, dtype=np.uint64) + np.uint64(977)) >> np.uint64(32)).astype(np.uint32)
ODD = np.uint32(0x9E3779B1)
END_TOKEN = np.uint64(0x5BD1E9955BD1E995)


# ---- symbols and bits


def laid_out(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of a slice with ``PAD`` symbols before each row."""
    rows = len(starts) - 1
    size = np.diff(starts)
    ends = np.cumsum(size + PAD + 2) - 1  # of the rows, with a separator and the end behind each
    text = np.ones(len(data) + rows * (PAD + 2), bool)
    begins = ends - size - PAD - 1
    for k in range(PAD):
        text[begins + k] = False
    text[ends - 1] = text[ends] = False
    raw = np.full(len(text), 32, np.uint8)
    raw[text] = data
    inside = IN_WORD[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    out = SYMBOLS[raw]
    out[ends] = END
    keep[ends] = True
    for k in range(PAD):
        out[begins + k] = BEFORE
        keep[begins + k] = True
    return out[keep]


def symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a slice with ``PAD`` symbols before each row; row of each; symbols of each row; token hashes and their rows."""
    out = laid_out(data, starts)
    room = np.diff(np.flatnonzero(out == END), prepend=-1)
    row = np.repeat(np.arange(len(room)), room)
    end = np.flatnonzero(out == 32)
    apart = np.flatnonzero((out == 32) | (out >= END))
    begin = apart[np.searchsorted(apart, end) - 1] + 1
    return out, row, room, X.span_hashes(X.prefix_sums(TOKEN_VALUES[out]), begin, end), row[end]


def contexts(symbol: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash per place and predictor of what stands before it."""
    value = VALUES[symbol]
    out, rolled, reach = [], np.zeros(len(symbol), np.uint32), 0
    for order in ORDERS:
        for k in range(reach + 1, order + 1):
            rolled *= ODD
            rolled[k:] += value[:-k]
        reach = order
        out.append(rolled + np.uint32(order * 0x1000193))
    # the word so far: prefix sums since the last separator
    ends = np.flatnonzero((symbol == 32) | (symbol >= END)) + 1
    up, down = X.powers(len(symbol))
    sums = np.zeros(len(symbol) + 1, np.uint32)
    np.cumsum(value * up[: len(symbol)].astype(np.uint32), dtype=np.uint32, out=sums[1:])
    start = np.concatenate([[0], ends])
    size = np.diff(np.append(start, len(symbol) + 1))
    word = sums - np.repeat(sums[start], size)
    word *= np.repeat(down[start].astype(np.uint32), size)
    out.append(word[:-1])
    return out


def distinct(symbol: np.ndarray, found: list[np.ndarray], numbered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Places to code that stand for all with the same symbol and contexts; for how many; and the number of the one that stands for each place."""
    key = found[-2].astype(np.uint64)  # the longest order; the shorter ones follow from it
    key <<= np.uint64(32)
    key |= found[-1]
    key += symbol.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    key *= np.uint64(X.BASE)
    low = np.uint64((1 << len(symbol).bit_length()) - 1)
    order = key & ~low
    order |= np.arange(len(symbol), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    key = key[order]
    new = np.ones(len(symbol), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(symbol)))
    places = order[first]
    coded = symbol[places] != BEFORE
    which = np.empty(len(symbol), np.int64) if numbered else None
    if numbered:
        which[order] = np.repeat(np.cumsum(coded) - 1, times)
    return places[coded], times[coded], which


def prefix_code(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Huffman code of the symbols: code lengths, and node and bit of every step of each code.

    Counts of two dimensions make a code for each row, that is for each symbol before.
    """
    paths = []
    for row, own in enumerate(np.atleast_2d(counts)):
        heap = [(int(c), s, s) for s, c in enumerate(own)]
        heapq.heapify(heap)
        parent, number = {}, len(own)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]], parent[b[2]] = (number, 0), (number, 1)
            heapq.heappush(heap, (a[0] + b[0], number, number))
            number += 1
        for s in range(len(own)):
            path, at = [], s
            while at in parent:
                at, bit = parent[at]
                path.append((at + 2 * row * len(own), bit))
            paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    steps = [step for path in paths for step in path]
    node = np.array([n for n, _ in steps], np.uint32) * np.uint32(0x85EBCA6B)
    begin = np.cumsum(length) - length
    return {"length": length.reshape(counts.shape), "begin": begin, "node": node, "bit": np.array([b for _, b in steps], np.int8)}


def steps(symbol: np.ndarray, at: np.ndarray, code: dict) -> tuple[np.ndarray, np.ndarray]:
    """First step and number of steps in the code of the symbols at ``at``."""
    coded = symbol[at]
    if code["length"].ndim == 2:
        coded += symbol[at - 1] * code["length"].shape[1]
    return code["begin"][coded], code["length"].reshape(-1)[coded]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them, one after the other."""
    out = np.repeat(begin - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def slots(context: np.ndarray, size: np.ndarray, node: np.ndarray, width: int) -> np.ndarray:
    h = np.repeat(context, size)
    h += node
    h *= ODD
    h >>= np.uint32(32 - width)
    return h.astype(np.intp)


# ---- the mixer


def _votes(found: list[np.ndarray], at: np.ndarray, begin: np.ndarray, size: np.ndarray, model: dict) -> np.ndarray:
    """Eight bytes for every bit of the symbols at ``at``: its predictions and a constant one, all as votes for its value, and the gate that chooses its weights."""
    step = ranges(begin, size)
    node = model["code"]["node"][step]
    out = np.zeros((len(step), 8), np.int8)
    gate = np.zeros(len(step), np.int8)
    out[:, PREDICTORS] = 2 * model["code"]["bit"][step] - 1
    for k, context in enumerate(found):
        vote = model["tables"][k][slots(context[at], size, node, model["width"])]
        np.maximum(gate, (vote != 0) * np.int8(k + 1), out=gate)
        np.multiply(vote, out[:, PREDICTORS], out=out[:, k])
    out[:, PREDICTORS + 1] = gate
    return out.view(np.int64)[:, 0]


def _by_gate(votes: np.ndarray) -> list[np.ndarray]:
    gate = np.ascontiguousarray(votes.view(np.int8).reshape(-1, 8)[:, PREDICTORS + 1])
    return [np.flatnonzero(gate == g) for g in range(GATES)]


def slopes(symbol: np.ndarray, model: dict, weights: np.ndarray) -> np.ndarray:
    """Per gate the slope of the log-likelihood at ``weights``, its negated curvature, and the number of bits."""
    found = contexts(symbol)
    places, times, _ = distinct(symbol, found, numbered=False)
    out = np.zeros((GATES, PREDICTORS + 1, PREDICTORS + 3))
    scaled = weights * SCALE
    for i in range(0, len(places), PART):
        begin, size = steps(symbol, places[i : i + PART], model["code"])
        votes = _votes(found, places[i : i + PART], begin, size, model)
        count = np.repeat(times[i : i + PART], size)
        for g, of_gate in enumerate(_by_gate(votes)):
            out[g, :, -1] += count[of_gate].sum()
            for j in range(0, len(of_gate), PART_BITS):
                at = of_gate[j : j + PART_BITS]
                vote = votes[at].view(np.int8).reshape(-1, 8)[:, : PREDICTORS + 1].T.astype(np.float64, order="C")
                z = scaled[g, 0] * vote[0]
                for k in range(1, PREDICTORS + 1):
                    z += scaled[g, k] * vote[k]
                missing = 1 / (1 + np.exp(np.clip(z, -11, 11)))
                both = np.empty((PREDICTORS + 2, len(at)))
                np.multiply(count[at], missing, out=both[0])
                np.multiply(vote, both[0] * (1 - missing), out=both[1:])
                out[g, :, :-1] += vote @ both.T
    out[:, :, :-1] *= SCALE[:, None]
    out[:, :, 1:-1] *= SCALE
    return out


def mix_bits(symbol, row, room, model, weights: np.ndarray, shared: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row. Every row's weights begin at ``weights`` and learn block by block.

    ``shared`` lets all rows use and change one set of weights, which is how it is trained.
    """
    rows, first = len(room), np.cumsum(room) - room
    at = np.flatnonzero(symbol != BEFORE)
    found = contexts(symbol)
    places, _, which = distinct(symbol, found)
    begin, size = steps(symbol, places, model["code"])
    votes = _votes(found, places, begin, size, model)
    begin = np.cumsum(size) - size
    own = row[at]
    block = (at - first[own] - PAD) // BLOCK
    order = np.argsort(block.astype(np.uint16) if len(at) < BLOCK << 16 else block, kind="stable")
    which, own, block = which[at[order]], own[order], block[order]
    cut = np.searchsorted(block, np.arange(block[-1] + 2)) if len(at) else np.zeros(1, np.int64)
    sets = 1 if shared else rows  # of weights
    held = np.repeat(weights.T, sets, axis=1).astype(np.float32)
    scale = SCALE.astype(np.float32)
    total = np.zeros(rows)
    for a, b in zip(cut, cut[1:], strict=False):
        part = which[a:b]
        vote = votes[ranges(begin[part], size[part])]
        bit_row, gates = np.repeat(own[a:b], size[part]), _by_gate(vote)
        order = np.concatenate(gates)  # a run of bits for each gate and row
        runs = np.concatenate([np.bincount(bit_row[gate], minlength=rows) for gate in gates])
        run = np.flatnonzero(runs)
        n, of = runs[run], run // rows if shared else run
        vote = vote[order].view(np.int8).reshape(-1, 8)
        vote = [vote[:, k].astype(np.float32) for k in range(PREDICTORS + 1)]
        z = vote[0] * np.repeat(held[0][of] * -scale[0], n)
        for k in range(1, PREDICTORS + 1):
            z += vote[k] * np.repeat(held[k][of] * -scale[k], n)
        np.clip(z, -11, 11, out=z)
        odds = np.exp(z, out=z)
        odds += 1
        missing = 1 - 1 / odds
        begins = np.cumsum(n) - n
        total += np.bincount(run % rows, np.add.reduceat(np.log(odds, out=odds), begins), rows)
        rate = RATE / (np.bincount(of, n, GATES * sets) + 200)
        for k in range(PREDICTORS + 1):
            slope = np.add.reduceat(missing * vote[k], begins)
            held[k] += (rate * scale[k] * np.bincount(of, slope, GATES * sets)).astype(np.float32)
    return total / math.log(2), held.T


# ---- learning


def _counted(df: DataFrame) -> DataFrame:
    """Counts over ``text``: of token hashes, the end of each text among them, and (``pair``) of symbols and the ones before them."""

    def run(batches):
        seen = np.zeros((BEFORE + 1) * (END + 1), np.int64)
        for batch in batches:
            found = [np.full(batch.num_rows, END_TOKEN)]
            for _, _, data, starts in _slices(batch.column(0)):
                symbol, _, _, tokens, _ = symbols(data, starts)
                at = np.flatnonzero(symbol != BEFORE)
                seen += np.bincount(symbol[at - 1] * (END + 1) + symbol[at], minlength=len(seen))
                found.append(tokens)
            value, count = np.unique(np.concatenate(found), return_counts=True)
            yield made(False, value.view(np.int64), count)
        value = np.flatnonzero(seen)
        yield made(True, value, seen[value])

    def made(pair, value, count):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), pair)), pa.array(value), pa.array(count)], ["pair", "h", "c"])

    return df.mapInArrow(run, "pair boolean, h bigint, c bigint").groupBy("pair", "h").agg(F.sum("c").alias("c"))


def _slices(column: pa.Array, limit: int = SLICE):
    data, starts = X.joined(column)
    for i, j in X.slices(starts, limit):
        yield i, j, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]


def _pairs(counted: DataFrame) -> np.ndarray:
    """How often each symbol stands behind each other one."""
    out = np.zeros((BEFORE + 1, END + 1), np.int64)
    for h, c in counted.where("pair").select("h", "c").collect():
        out.reshape(-1)[h] = c
    return out


def _symbol_counts(df: DataFrame) -> np.ndarray:
    """How often each symbol stands in ``text``, over all rows."""
    return _pairs(_counted(df)).sum(axis=0)


def _tables(df: DataFrame, code: dict, width: int) -> list[list[np.ndarray]]:
    """Predictions of every context slot, in sixteenths of the logistic domain: by the counts of either half of ``df``, and of all of it."""
    sent = df.sparkSession.sparkContext.broadcast(code)
    per_half = max(1, df.sparkSession.sparkContext.defaultParallelism // 2)

    def run(batches):
        seen = np.zeros((PREDICTORS, 2 << width), np.uint32)
        for batch in batches:
            for _, _, data, starts in _slices(batch.column(0), LEARN_SLICE):
                symbol = laid_out(data, starts)
                found = contexts(symbol)
                places, times, _ = distinct(symbol, found, numbered=False)
                for i in range(0, len(places), PART):
                    at = places[i : i + PART]
                    begin, size = steps(symbol, at, sent.value)
                    step, count = ranges(begin, size), np.repeat(times[i : i + PART].astype(np.uint32), size)
                    node, bit = sent.value["node"][step], sent.value["bit"][step]
                    for k, context in enumerate(found):
                        np.add.at(seen[k], slots(context[at], size, node, width) * 2 + bit, count)
        step = 2 * BLOCK_SLOTS
        for k in range(PREDICTORS):
            for begin in range(0, -(-(2 << width) // step), SENT_BLOCKS):  # few at a time: they are copied on their way
                parts = [(n, seen[k, n * step : (n + 1) * step]) for n in range(begin, begin + SENT_BLOCKS)]
                parts = [(n, p) for n, p in parts if p.any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(parts), pa.int32()), pa.array([n for n, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())],
                    ["k", "n", "seen"],
                )

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros((3, 2 * BLOCK_SLOTS), np.int64)
        for half, part in zip(table.column("half").to_pylist(), table.column("seen"), strict=True):
            own = np.frombuffer(part.as_py(), np.uint32)
            total[half, : len(own)] += own
        total[2] = total[0] + total[1]
        zero, one = total[:, 0::2], total[:, 1::2]
        vote = np.clip(np.rint(16 * np.log((one + 0.4) / (zero + 0.4))), -127, 127).astype(np.int8)
        return pa.table({"k": table.column("k")[:1], "n": table.column("n")[:1], "votes": pa.array([vote.tobytes()], pa.binary())})

    # one set of counts per core, not per file: half of the cores for each half
    parts = [df.where(F.col("half") == half).select("text").coalesce(per_half).mapInArrow(run, "k int, n int, seen binary").withColumn("half", F.lit(half)) for half in (0, 1)]
    rows = parts[0].union(parts[1]).groupBy("k", "n").applyInArrow(summed, "k int, n int, votes binary").toArrow()
    tables = [[np.zeros(max(1 << width, BLOCK_SLOTS), np.int8) for _ in range(PREDICTORS)] for _ in range(3)]
    for k, n, votes in zip(rows.column("k").to_pylist(), rows.column("n").to_pylist(), rows.column("votes"), strict=True):
        for table, vote in zip(tables, np.frombuffer(votes.as_py(), np.int8).reshape(3, -1), strict=True):
            table[k][n * BLOCK_SLOTS : (n + 1) * BLOCK_SLOTS] = vote
    return tables


def _rehearse(sample: list[tuple[str, int]], halves: list[dict]) -> np.ndarray:
    """Weights to start from: a few passes over some texts, each with the tables of the half that it is not in."""
    weights = np.full((GATES, PREDICTORS + 1), 0.4, np.float32)
    weights[:, PREDICTORS] = 0
    columns = [pa.array([text for text, own in sample if own == half], pa.string()) for half in (0, 1)]
    for _ in range(3):
        for half in (0, 1):
            for _, _, data, starts in _slices(columns[half]):
                symbol, row, room, _, _ = symbols(data, starts)
                _, weights = mix_bits(symbol, row, room, halves[1 - half], weights, shared=True)
    return weights


def _learnt(df: DataFrame, halves: list[dict], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after a Newton step from ``start`` over all rows of ``df``, and the number of bits that each gate saw.

    The tables of a half predict the texts of the other one. What is summed are plain numbers, so the weights
    do not depend on which task has which row.
    """
    sent = df.sparkSession.sparkContext.broadcast((halves, start))

    def run(batches):
        halves, start = sent.value
        total = np.zeros((GATES, PREDICTORS + 1, PREDICTORS + 3))
        for batch in batches:
            for half in (0, 1):
                column = batch.column(0).filter(pc.equal(batch.column(1), half))
                for _, _, data, starts in _slices(column, LEARN_SLICE):
                    total += slopes(laid_out(data, starts), halves[1 - half], start)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["i", "x"])

    total = np.zeros((GATES, PREDICTORS + 1, PREDICTORS + 3))
    for i, x in df.select("text", "half").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x")).collect():
        total.reshape(-1)[i] = x
    sent.unpersist()
    step = np.linalg.solve(total[:, :, 1:-1] + np.eye(PREDICTORS + 1), total[:, :, :1])[:, :, 0]
    return (start + np.clip(step, -1, 1)).astype(np.float32), total[:, 0, -1].astype(np.int64)


def score(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, frequent: int = FREQUENT, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``bits``, ``score``.

    ``learn`` marks the rows to learn from. Token, symbol and context counts and the mixing weights cover all
    of them; ``sample`` rows of lowest hash only say where the weights begin. ``base_score`` is the
    add-half unigram score, ``score`` the mixing model's; both are log10 probabilities of the text's
    tokens. Null, empty and wordless texts have the end token only. Rows are scored alone, equal
    texts alike. Without training rows all contexts are unseen. Tokens are told apart by 64-bit
    hashes. The ``frequent`` most common tokens are sent to every task, the rest are joined, so the
    counts are exact. Columns named like the results are replaced, any other name is free. With ``keep``
    the result has these columns of ``df`` only, and the others, as the text, are not stored on the way.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "bits", "score")
    mark = X.free(df, "learn")
    df = df.withColumn(mark, learn).drop(*made)
    kept = None if keep is None else {c.lower() for c in keep}
    use = [c for c in df.columns if c != mark and (kept is None or c.lower() in kept)]
    df, named = X.shielded(df, key=key, text=text, learn=mark)
    use = [c for c, old in zip(df.columns, named(df).columns, strict=True) if old in use]
    key, text = "own_key", "own_text"
    training = df.where("own_learn").select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.lit("rehearsal"), key, text).alias("_drawn"))
    training = training.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int"))  # copies are in one half
    counted = X.stored(_counted(training.select("text")), "token-counts")
    counts = counted.where(~F.col("pair")).select("h", "c")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common, known = _common(counts, frequent)

    size, rows = training.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    limit = int(min(1.0, sample / max(rows, 1)) * (2**64 - 1)) - 2**63  # about ``sample`` rows, at most a quarter
    limit = limit if rows >= 4 * sample else -(2**63) + (2**62 if rows > 1 else 0)
    rehearsal = [tuple(r) for r in training.where(F.col("_drawn") < limit).select("text", "half").toLocalIterator()]
    width = int(min(LARGEST_BITS, max(16, math.ceil(math.log2(max(size, 1) / 128 + 1)))))
    model = {"code": prefix_code(1 + _pairs(counted)), "width": width}
    *halves, model["tables"] = _tables(training, model["code"], width)
    halves = [model | {"tables": tables} for tables in halves]
    model["weights"] = _learnt(training, halves, _rehearse(rehearsal, halves))[0]
    model["common"], model["known"] = common, known
    df = df.drop("own_learn")
    return named(_joined(_scored(df, text, model, set(df.columns) - set(use)), counts, n, v, use))


def _common(counts: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the tokens above the lowest power of two that at most ``frequent`` reach."""
    levels = dict(counts.groupBy(F.floor(F.log2("c")).alias("level")).count().collect())
    total, least = 0, 63
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > frequent:
            break
        least = level
    table = counts.where(F.col("c") >= 2**least).toArrow().sort_by("h") if least < 63 else None
    if table is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return table["h"].to_numpy(), table["c"].to_numpy()


def _scored(df: DataFrame, text: str, model: dict, without: set[str]) -> DataFrame:
    """Bits, tokens, the known part of the base score, and the tokens that are not common, beside all columns but ``without``."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    column = next(i for i, c in enumerate(df.columns) if c.lower() == text.lower())

    def run(batch):
        model = sent.value
        common, logs = model["common"], np.log10(model["known"] + 0.5)
        total, n_tokens, n_known, known, rare, times, sizes = [], [], [], [], [], [], [np.zeros(1, np.int64)]
        for i, j, data, starts in _slices(batch.column(column)):
            symbol, row, room, tokens, owner = symbols(data, starts)
            total.append(mix_bits(symbol, row, room, model, model["weights"])[0])
            owner = np.concatenate([owner, np.arange(j - i)])
            tokens = np.concatenate([tokens, np.full(j - i, END_TOKEN)]).view(np.int64)
            value, own = np.unique(tokens, return_inverse=True)
            at = np.minimum(np.searchsorted(common, value), max(len(common) - 1, 0))
            hit = common[at] == value if len(common) else np.zeros(len(value), bool)
            logs_of = np.where(hit, logs[at], 0) if len(common) else np.zeros(len(value))
            n_tokens.append(np.bincount(owner, minlength=j - i))
            n_known.append(np.bincount(owner, hit[own], j - i))
            known.append(np.bincount(owner, logs_of[own], j - i))
            left = np.flatnonzero(~hit[own])
            pair, count = np.unique(owner[left] * len(value) + own[left], return_counts=True)
            rare.append(value[pair % len(value)])
            times.append(count)
            sizes.append(np.bincount(pair // len(value), minlength=j - i))
        cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        places = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        return [
            pa.array(cat(total, np.float64)), pa.array(cat(n_tokens, np.int64)), pa.array(cat(n_known, np.int64)),
            pa.array(cat(known, np.float64)), pa.ListArray.from_arrays(places, pa.array(cat(rare, np.int64))),
            pa.ListArray.from_arrays(places, pa.array(cat(times, np.int64))),
        ]

    return X.append(df, "bits double, n_tokens bigint, _known bigint, _logs double, _rare array<bigint>, _times array<bigint>", run, without)


def _joined(scored: DataFrame, counts: DataFrame, n: int, v: int, columns: list[str]) -> DataFrame:
    """The common part and the joined part of the base score together."""
    rows = X.stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    found = rows.select("_row", F.inline(F.arrays_zip(F.col("_rare").alias("h"), F.col("_times").alias("times")))).join(counts, "h", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = found.groupBy("_row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_rare_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("_rare_logs")
    )
    norm = math.log10(n + 0.5 * (v + 1))
    both = rows.drop("_rare", "_times").join(rare, "_row", "left")
    return both.select(
        *columns, "n_tokens", (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("_logs") + F.coalesce("_rare_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        "bits", (-F.col("bits") * math.log10(2)).alias("score"),
    )
