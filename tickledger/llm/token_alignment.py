"""Alignment of two tokenizers' tokens by merge-path partitioning of their byte ends.

The ends of the A tokens and those of the B tokens of a run of texts are two sorted lists. Their
merge is a path through a grid; evenly spaced diagonals of the grid cut it into pieces of equal
work, and a binary search per diagonal finds where the path crosses it. The pieces are then merged
side by side, one step of all pieces at a time, and emit the pairs of tokens that overlap. Groups
are cut where an A end meets a B end; a group that lies over several pieces is put together from
the numbers of such cuts before each token.

Counts of id pairs over the corpus are a hash aggregate. The most frequent pairs, a bounded number,
are looked up inside the tasks; all others are joined.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickledger.llm import bpe
from tickledger.llm import texts as X

PIECE = 256
COMMON_PAIRS = 500_000
SLICE_BYTES = 1 << 19
HELD_PAIRS = 1 << 21
DECIMALS = 1 << 17
UNIT = re.compile(r"(?<=\S)(?= )")
KEPT_CHARS = 1 << 22


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first ``diagonals`` elements of the merge; equal ends take ``a`` first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (todo := low < high).any():
        middle = (low + high) >> 1
        before = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - middle - 1, 0, len(b) - 1)]
        low = np.where(todo & before, middle + 1, low)
        high = np.where(todo & ~before, middle, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens whose bytes overlap, in order; ``a`` and ``b`` are ends, last ones equal."""
    total = len(a) + len(b)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    diagonals = np.arange(0, total, piece)
    i = crossings(a, b, diagonals)
    j = diagonals - i
    size = np.minimum(piece, total - diagonals)
    a_begin, b_begin = np.concatenate([[0], a]), np.concatenate([[0], b])
    a_end, b_end = np.append(a, a[-1] + 1), np.append(b, b[-1] + 1)
    left, right = np.full((len(diagonals), piece), -1, np.int64), np.full((len(diagonals), piece), -1, np.int64)
    for step in range(min(piece, total)):
        if size[-1] <= step:  # only the last piece is shorter
            i, j, size = i[:-1], j[:-1], size[:-1]
        x, y = a_end[i], b_end[j]
        hit = (a_begin[i] < y) & (b_begin[j] < x)
        at = np.flatnonzero(hit)
        left[at, step], right[at, step] = i[at], j[at]
        take = x <= y
        i, j = i + take, j + ~take
    keep = left.ravel() >= 0
    return left.ravel()[keep], right.ravel()[keep]


class Pair:
    """Two tokenizers and the bytes of their tokens, for use in a task."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=b_file)
        back = {c: i for i, c in enumerate(bpe.byte_letters())}
        vocab = json.loads(a_file)["model"]["vocab"]
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(back[c] for c in token)
        b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.tokens = [(np.frombuffer(b"".join(t), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in t])])) for t in (a_bytes, b_bytes)]

        # no token of B has a space behind other characters, and none of A's pieces has: both may be cut there
        inner = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.cut = (lambda t: [" " + t]) if inner else (lambda t: UNIT.split(" " + t))
        self.digits = decimals()
        self.forget()

    def forget(self) -> None:
        """Units encoded so far: a number for each, and their ids of either side end to end."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids = [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2

    def learn(self, units: list[str]) -> None:
        """Encode units: laid end to end where a side's tokens end with every unit, else one by one."""
        plain = [u for u in units if not u[-1].isspace()]
        units = plain + [u for u in units if u[-1].isspace()]
        ends = np.cumsum([len(u.encode()) for u in plain])
        # B adds the space itself, but to no empty text
        behind = lambda t: self.b.encode("a" + t)[len(self.b.encode("a")) :]
        one = (lambda t: self.a.encode(t, add_special_tokens=False).ids, lambda t: self.b.encode(t[1:]) if t[1:] else behind(t))
        base = len(self.known)
        self.known.update((u, base + i) for i, u in enumerate(units))
        self.chars += sum(map(len, units))
        for side, encode in enumerate(one):
            ids = np.array(encode("".join(plain)) if plain else [], np.int64)
            starts = self.tokens[side][1]
            at = np.cumsum(starts[ids + 1] - starts[ids])
            sizes = np.diff(np.searchsorted(at, ends) + 1, prepend=0)
            done = len(plain)
            if done and not (len(at) and at[-1] == ends[-1] and np.isin(ends, at).all()):
                ids, sizes, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            rows = [encode(u) for u in units[done:]]
            flat, before = self.ids[side]
            flat = np.concatenate([flat, ids, np.array([x for r in rows for x in r], np.int64)])
            self.ids[side] = flat, np.concatenate([before, before[-1] + np.cumsum(np.concatenate([sizes, np.array([len(r) for r in rows], np.int64)]))])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of space and text of each side; an empty text has none. Each distinct unit is encoded once."""
        cut = [self.cut(t) if t else [] for t in texts]
        if self.chars > KEPT_CHARS:
            self.forget()
        if new := list(set().union(*cut).difference(self.known)):
            self.learn(new)
        numbers = [np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)) for units in cut]
        return tuple([bpe.gather(flat, ends[n], ends[n + 1]) for n in numbers] for flat, ends in self.ids)


def laid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end, and where each starts."""
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def decimals() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids end to end, each with room for the sign behind it."""
    words = [b"%d," % i for i in range(DECIMALS)]
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])


class Aligned:
    """Tokens, links and groups of some texts."""

    def __init__(self, texts: list[str | None], pair: Pair):
        filled = [t or "" for t in texts]
        rows = pair.encode(filled)
        raw = [(" " + t).encode() if t else b"" for t in filled]
        fits = np.array([bool(t) for t in filled])
        for ids, (flat, starts) in zip(rows, pair.tokens, strict=True):
            for k in np.flatnonzero(fits):
                fits[k] = bpe.gather(flat, starts[ids[k]], starts[ids[k] + 1]).tobytes() == raw[k]
        empty = np.zeros(0, np.int64)
        rows = [[r if fit else empty for r, fit in zip(ids, fits, strict=True)] for ids in rows]
        (self.a, self.a_at), (self.b, self.b_at) = map(laid, rows)
        # one line of bytes for all texts: every text ends where an A and a B token end
        a_end, b_end = (np.cumsum(starts[ids + 1] - starts[ids]) for ids, (_, starts) in zip((self.a, self.b), pair.tokens, strict=True))
        self.left, self.right = overlaps(a_end, b_end)
        meet_a, meet_b = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        self.group_a, self.group_b = (np.cumsum(m) - m for m in (meet_a, meet_b))
        self.last_a, self.last_b = meet_a, meet_b
        self.n = len(texts)

    def per_row(self, numbers: np.ndarray) -> np.ndarray:
        """Row of each A token number."""
        return np.searchsorted(self.a_at, numbers, "right") - 1

    def lines(self, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        flat, starts = digits
        n_a, n_b = np.bincount(self.group_a), np.bincount(self.group_b)
        before_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
        ids, sign = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        for at, own, last, mark in (
            (np.arange(len(self.a)) + before_b[self.group_a], self.a, self.last_a, b"|"), (np.arange(len(self.b)) + before_a[self.group_b], self.b, self.last_b, b";"),
        ):
            ids[at], sign[at] = own, np.where(last, mark[0], b","[0])
        text = bpe.gather(flat, starts[ids], starts[ids + 1]).copy()
        ends = np.cumsum(starts[ids + 1] - starts[ids])
        text[ends - 1] = sign
        cut = np.concatenate([[0], ends])[self.a_at + self.b_at]
        return [text[i : max(i, j - 1)].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, A id, B id and number of links of each distinct id pair of a row."""
        row, key = self.per_row(self.left), self.a[self.left] << 17 | self.b[self.right]
        if not len(row):
            return (np.zeros(0, np.int64),) * 4
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(key) != 0)]))
        key = key[first]
        return row[first], key >> 17, key & ((1 << 17) - 1), np.diff(np.append(first, len(row)))


def _files(df: DataFrame, a_path: str, b_path: str):
    """Both tokenizer files, read once by the driver: a few megabytes."""
    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            contents.append(f.read())
    return df.sparkSession.sparkContext.broadcast(contents)


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``df`` with n_a, n_b, n_groups, n_links, ``groups`` (ids as ``a1,a2|b1;a3|b2,b3``) and its distinct id pairs.

    The pairs of a row are three lists: ``pair_a``, ``pair_b`` and ``pair_links``, how many links have
    these ids. Both tokenizers see a space and the text, without special tokens. Null and empty texts,
    and texts whose tokens of either side do not spell these bytes, have none of it. Columns named like
    the results are replaced, rows are aligned alone, and a text of any length is cut into pieces.
    """
    column = next(i for i, c in enumerate(df.columns) if c.lower() == text.lower())
    sent = _files(df, a_path, b_path)
    name = f"tokens of {a_path} and {b_path}"

    def made(batch):
        pair = X.kept_in_worker(name, lambda: Pair(*sent.value))
        parts = []
        for i, j in X.slices(X.joined(batch.column(column))[1], SLICE_BYTES):
            found = Aligned(batch.column(column)[i:j].to_pylist(), pair)
            n, ends = j - i, np.searchsorted(np.cumsum(found.last_a), np.arange(1, found.last_a.sum() + 1))
            row, a, b, links = found.pairs()
            counts = [np.diff(found.a_at), np.diff(found.b_at), np.bincount(found.per_row(ends), minlength=n), np.bincount(row, links, minlength=n).astype(np.int64)]
            parts.append([
                *(pa.array(c, pa.int64()) for c in counts), pa.array([x.decode() for x in found.lines(pair.digits)], pa.string()),
                _lists(a, row, n, pa.int32()), _lists(b, row, n, pa.int32()), _lists(links, row, n, pa.int32()),
            ])
        return [pa.concat_arrays(c) for c in zip(*parts, strict=True)]

    return X.append(df, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pair_a array<int>, pair_b array<int>, pair_links array<int>", made)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many rows hold each id pair, and whether no other pair of the A id is held by more.

    Pairs are counted inside the tasks first, at most ``HELD_PAIRS`` numbers at a time.
    """

    def counted(batches):
        held, size = [], 0

        def total():
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            keys, of = np.unique(keys, return_inverse=True)
            return keys, np.bincount(of, n).astype(np.int64)

        out = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys >> 17, pa.int32()), pa.array(keys & ((1 << 17) - 1), pa.int32()), pa.array(n)], ["a", "b", "n"])
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (0, 1))
            held.append(tuple(np.unique(a << 17 | b, return_counts=True)))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [total()]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*total())

    counts = aligned.select("pair_a", "pair_b").mapInArrow(counted, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("documents"))
    # an A id meets at most as many ids as B has
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def score(aligned: DataFrame, counts: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair is a best one of its A id) and ``count_sum`` (counts over the links).

    The ``common_pairs`` most frequent pairs are sent to the tasks, 17 bytes each; the other pairs of
    a row are joined to ``counts``. ``aligned`` is read twice, so write it first.
    """
    head = counts.orderBy(F.col("documents").desc(), "a", "b").limit(common_pairs).toArrow()
    key = head["a"].to_numpy().astype(np.int64) << 17 | head["b"].to_numpy()
    order = np.argsort(key)
    sent = aligned.sparkSession.sparkContext.broadcast((key[order], head["documents"].to_numpy()[order], head["best"].to_numpy()[order]))
    lists = [aligned.columns.index(c) for c in ("pair_a", "pair_b", "pair_links")]

    def made(batch):
        keys, documents, best = sent.value
        a, b, links = (batch.column(c) for c in lists)
        size = a.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(batch.num_rows), size)
        a, b, links = (c.flatten().to_numpy().astype(np.int64) for c in (a, b, links))
        pair = a << 17 | b
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1) if len(keys) else np.zeros(len(pair), np.int64)
        known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        np.add.at(n_best, row[known], links[known] * best[at[known]])
        np.add.at(count_sum, row[known], links[known] * documents[at[known]])
        rest = [_lists(c[~known], row[~known], batch.num_rows, pa.int32()) for c in (a, b, links)]
        return [pa.array(n_best), pa.array(count_sum), pa.array(np.bincount(row[~known], minlength=batch.num_rows)), *rest]

    row, left, other_a, other_b, other_links, best, total = (X.free(aligned, n) for n in ("row", "left", "a", "b", "links", "best", "total"))
    looked = X.append(aligned, f"n_best bigint, count_sum bigint, {left} bigint, {other_a} array<int>, {other_b} array<int>, {other_links} array<int>", made)
    looked = looked.withColumn(row, F.monotonically_increasing_id())
    rest = looked.where(F.col(left) > 0).select(row, F.explode(F.arrays_zip(other_a, other_b, other_links)).alias("p"))
    rest = rest.select(row, *[F.col("p")[c].alias(n) for c, n in ((other_a, "a"), (other_b, "b"), (other_links, "links"))]).join(counts, ["a", "b"])
    sums = rest.groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias(best), F.sum(F.col("links") * F.col("documents")).alias(total)
    )
    none = F.lit(0).cast("bigint")
    names = [c for c in aligned.columns if c.lower() not in {"n_best", "count_sum"}]
    return looked.join(sums, row, "left").select(
        *[F.col(f"`{c}`") for c in names], (F.col("n_best") + F.coalesce(best, none)).alias("n_best"), (F.col("count_sum") + F.coalesce(total, none)).alias("count_sum")
    )


def digest(df: DataFrame) -> DataFrame:
    """``df`` of ``align`` with ``groups_sha256`` in place of ``groups``: empty without tokens."""
    hashed = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return df.withColumn("groups_sha256", hashed).drop("groups")

