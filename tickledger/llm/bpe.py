"""Byte-level BPE encoding and decoding with the vocabulary of a tokenizer file.

A text is cut into pieces by the tokenizer's pattern. In each piece the ranks of adjacent pairs are
the leaves of a segment tree of minima: its root is the leftmost merge of lowest rank, and a merge
changes three leaves and their paths. Short pieces of one size are merged side by side in numpy.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickledger.llm import texts as X

# White space as the tokenizer's pattern means it, and that pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
NEVER = np.int64(1) << 62
SIDE_BY_SIDE = 256
PIECES_KEPT = 300_000


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file with a byte-level BPE model."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = first.astype(np.int64)
        self.rank_of = dict(zip(keys[::-1].tolist(), range(len(keys) - 1, -1, -1), strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        """Pieces already encoded: a number for each, and its ids end to end with the others'."""
        self.known: dict[str, int] = {s: i for i, s in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.int32)
        self.ends = np.arange(len(self.special) + 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def split(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.pattern.findall(text)
        out, last = [], 0
        for m in self.cut.finditer(text):
            out += self.pattern.findall(text[last : m.start()])
            out.append(m.group())
            last = m.end()
        return out + self.pattern.findall(text[last:])

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces and remember them."""
        raw = [p.encode() for p in pieces]
        length = np.array([len(r) for r in raw])
        done: list[np.ndarray] = [None] * len(raw)
        size = np.where(length > 1, 1 << np.ceil(np.log2(np.maximum(length - 1, 1))).astype(np.int64), 0)
        for s in np.unique(size):
            of = np.flatnonzero(size == s)
            if s > SIDE_BY_SIDE:
                for i in of:
                    done[i] = merge_one(self.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist(), self)
                continue
            for at in range(0, len(of), max(1, (1 << 20) // (int(s) + 1))):
                part = of[at : at + max(1, (1 << 20) // (int(s) + 1))]
                for i, ids in zip(part, merge_all([raw[i] for i in part], int(s), self), strict=True):
                    done[i] = ids
        base = len(self.known)
        self.known.update((p, base + i) for i, p in enumerate(pieces))
        sizes = np.array([len(d) for d in done])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, *done]).astype(np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts' new pieces are encoded together."""
        cut = [self.split(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > PIECES_KEPT:
            self.forget()
            new = list(set().union(*cut).difference(self.known))
        if new:
            self.learn(new)
        out = []
        for pieces in cut:
            number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            out.append(gather(self.ids, self.ends[number], self.ends[number + 1]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.starts) - 1)]
        return gather(self.bytes, self.starts[ids], self.starts[ids + 1]).tobytes().decode("utf-8", "replace")


def gather(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``flat[begin:end]`` of each pair, laid end to end."""
    size = end - begin
    return flat[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]


def merge_one(ids: list[int], v: Vocabulary) -> np.ndarray:
    """Ids of one long piece, given the ids of its bytes."""
    n = len(ids)
    size = 1 << (n - 1).bit_length()
    never = int(NEVER)
    key = lambda a, b: v.rank_of.get(ids[a] << 32 | ids[b], -1)
    tree = [never] * (2 * size)

    def put(at: int, rank: int) -> None:
        node = size + at
        tree[node] = rank << 32 | at if rank >= 0 else never
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

    for i in range(n - 1):
        rank = key(i, i + 1)
        tree[size + i] = rank << 32 | i if rank >= 0 else never
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merged = v.merged.tolist()
    while tree[1] < never:
        rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        gone = after[at]
        ids[at], ids[gone] = merged[rank], -1
        after[at] = after[gone]
        put(gone, -1)
        if after[at] < n:
            before[after[at]] = at
            put(at, key(at, after[at]))
        else:
            put(at, -1)
        if before[at] >= 0:
            put(before[at], key(before[at], at))
    return np.array([i for i in ids if i >= 0], np.int64)


def merge_all(pieces: list[bytes], size: int, v: Vocabulary) -> list[np.ndarray]:
    """Ids of pieces of at most ``size + 1`` bytes, each with a segment tree of ``size`` leaves."""
    length = np.array([len(p) for p in pieces])
    if size == 0:
        return np.split(v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.cumsum(length)[:-1])
    w, n = len(pieces), size + 1
    ids = np.full((w, n + 1), -1, np.int64)
    real = np.arange(n)[None] < length[:, None]
    ids[:, :n][real] = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    tree = np.full((w, 2 * size), NEVER, np.int64)
    rank = v.pair_ranks(ids[:, : n - 1], ids[:, 1:n])
    pair = real[:, 1:] & (rank < NEVER)
    tree[:, size:][pair] = (rank << 32 | np.arange(size)[None])[pair]
    for node in range(size - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    after, before = np.tile(np.arange(1, n + 2), (w, 1)), np.tile(np.arange(-1, n), (w, 1))

    def put(row, at, left, right, use):
        """Leaves ``at`` get the rank of their pair, or none where ``use`` is false."""
        rank = np.where(use, v.pair_ranks(np.where(use, ids[row, left], 0), np.where(use, ids[row, right], 0)), NEVER)
        node = at + size
        tree[row, node] = np.where(rank < NEVER, rank << 32 | at, NEVER)
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    while len(row := np.flatnonzero(tree[:, 1] < NEVER)):
        root = tree[row, 1]
        at = root & 0xFFFFFFFF
        gone = after[row, at]
        behind = after[row, gone]
        ids[row, at], ids[row, gone] = v.merged[root >> 32], -1
        after[row, at] = behind
        inside = behind < length[row]
        before[row[inside], behind[inside]] = at[inside]
        none = np.zeros(len(row), bool)
        put(row, np.minimum(gone, size - 1), at, at, none)  # the last byte begins no pair
        put(row, at, at, np.minimum(behind, n), inside)
        ahead = before[row, at]
        some = ahead >= 0
        if some.any():
            put(row[some], ahead[some], ahead[some], at[some], none[some] | True)
    kept = ids[:, :n] >= 0
    return np.split(ids[:, :n][kept], np.cumsum(kept.sum(axis=1))[:-1])


def _vocabulary(text: str) -> Vocabulary:
    return X.kept_in_worker(f"vocabulary {zlib.crc32(text.encode())}", lambda: Vocabulary(text))


def _file(df: DataFrame, path: str):
    """The tokenizer file's text, read once by the driver: about a megabyte."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``: the token ids of the whole text as one array; null and empty texts give none.

    ``path`` is the tokenizer file. The strings of special tokens in a text become these tokens.
    Rows are encoded alone; a column named ``ids`` is replaced.
    """
    column = next(i for i, c in enumerate(df.columns) if c.lower() == text.lower())
    sent = _file(df, path)

    def made(batch):
        v = _vocabulary(sent.value)
        rows, every = [], batch.column(column).fill_null("")
        for i, j in X.slices(X.joined(every)[1], 1 << 20):
            rows += v.encode(every[i:j].to_pylist())
        places = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        flat = np.concatenate([np.zeros(0, np.int32), *rows])
        return [pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat, pa.int32()))]

    return X.append(df, "ids array<int>", made)


def decoder(df: DataFrame, path: str, ids: str = "ids"):
    """The function of an Arrow batch of ``df`` behind ``decode``, for callers that need more of the batch."""
    column = next(i for i, c in enumerate(df.columns) if c.lower() == ids.lower())
    sent = _file(df, path)

    def made(batch):
        v = _vocabulary(sent.value)
        rows = batch.column(column)
        valid = rows.is_valid().to_numpy(zero_copy_only=False)
        values = [rows[i].values.to_numpy().astype(np.int64) if valid[i] else np.zeros(0, np.int64) for i in range(len(rows))]
        return [pa.array([v.decode(x) for x in values], pa.string())]

    return made


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of an id array; a null array gives the empty text, unknown ids give nothing.

    Bytes that are no UTF-8 become U+FFFD. A column with the name of the result is replaced.
    """
    return X.append(df, f"{name} string", decoder(df, path, ids))
