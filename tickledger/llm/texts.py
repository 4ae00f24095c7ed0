"""Texts of an Arrow batch as one run of bytes, with hashes and words over it; used inside tasks.

Hashes are sums of random byte values times powers of an odd number, modulo 2**64. A prefix sum
gives the hash of any span in one step: the power of its place is divided out.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger.session import shared_path

SLICE_BYTES, SLICE_ROWS = 2 << 20, 2000
PART_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and where each row starts; null is empty."""
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = pc.fill_null(binary, b"")
    if not len(binary):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = binary.buffers()
    starts = np.frombuffer(places, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Runs of at most ``rows`` rows and ``limit`` bytes; a longer row is a run of its own."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1))
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n + 1`` of each."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, out=row)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit number, so that any part of it can be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the content of ``[begin, end)``, the same wherever it stands."""
    _, down = powers(len(sums))
    length = (end - begin).astype(np.uint64)
    return mix((sums[end] - sums[begin]) * down[begin] + length * np.uint64(0xD6E8FEB86659FD93))


def hashes_of_length(sums: np.ndarray, length: int) -> np.ndarray:
    """``span_hashes`` of all spans of one length, in order of their place."""
    _, down = powers(len(sums))
    h = sums[length:] - sums[:-length]
    h *= down[: len(h)]
    h += np.uint64(length * 0xD6E8FEB86659FD93 % 2**64)
    return mix(h)


def words(data: np.ndarray, starts: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every maximal run of word bytes; runs never cross rows."""
    inside = in_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = starts[:-1][starts[:-1] < starts[1:]]
    before[first] = False
    after[first[1:] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def distinct_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), in order; the rows come in order."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def remainder(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def free(df: DataFrame, name: str) -> str:
    """A name like this one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shielded(df: DataFrame, **own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with each column of ``own`` called ``own_`` and its keyword, all others ``user_`` and a number.

    No column of the user can then meet a name that an operator uses inside. The function that
    comes with it gives the columns of a result their old names back. Letter case is ignored.
    """
    known = {given.lower(): f"own_{use}" for use, given in own.items()}
    names = [known.get(c.lower(), f"user_{i}") for i, c in enumerate(df.columns)]
    old = dict(zip(names, df.columns, strict=True))
    return df.toDF(*names), lambda made: made.toDF(*[old.get(c, c) for c in made.columns])


def _held() -> dict:
    return sys.modules.setdefault("worker memory", types.ModuleType("worker memory")).__dict__


def kept_in_worker(name: str, make: Callable):
    """What ``make`` returns, kept by this Python process for its next tasks; one value per name.

    Functions reach the workers by value and would start anew in each task, so what is dear to load
    is put where the process keeps its modules. Values with a method ``forget`` lose what they have
    learnt from texts at the end of a task, so that later stages find the memory free.
    """
    held = _held()
    if name not in held:
        held[name] = make()
    return held[name]


def forget_texts() -> None:
    for value in list(_held().values()):
        if hasattr(value, "forget"):
            value.forget()


def append(df: DataFrame, ddl: str, function: Callable[[pa.RecordBatch], list[pa.Array]], without: Iterable[str] = ()) -> DataFrame:
    """``df`` with the columns of ``ddl`` that ``function`` makes of each Arrow batch.

    A column of ``df`` with the name of a new one is replaced, those of ``without`` end here. Batches are cut to about ``PART_BYTES``.
    """
    new = T._parse_datatype_string(ddl)
    taken = {name.lower() for name in [*new.names, *without]}
    keep = [i for i, field in enumerate(df.schema.fields) if field.name.lower() not in taken]
    schema = T.StructType([df.schema.fields[i] for i in keep] + new.fields)
    names = schema.names

    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * PART_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = pa.RecordBatch.from_arrays([c.slice(at, step) for c in batch.columns], batch.schema.names)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + function(part), names)
        forget_texts()

    return df.mapInArrow(run, schema)


def by_slice(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, bytes and row starts of each slice of a string column."""
    data, starts = joined(column)
    for i, j in slices(starts):
        yield i, j, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again, so that no lost executor repeats its lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
