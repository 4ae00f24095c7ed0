"""The replay fence as a stream: a partition's records wait until the marker of the own generation comes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickledger import schemas as S
from tickledger.functions import codec

# The processor runs in Python workers that need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_ROWS = 10_000
RECORD = ["offset", "time_us", "key", "value"]
HELD_SCHEMA = "offset long, time_us long, key binary, value binary"
OUTPUT_SCHEMA = f"partition int, {HELD_SCHEMA}, fence long, phase string"


class FenceProcessor(StatefulProcessor):
    """Per partition: the offset of the own marker once it was seen, and the records that wait for it.

    Records keep their order in a partition, as the log gives them; those of one batch are sorted by
    offset once. What waits lies in a list state on disk and is handed on in frames of ``PART_ROWS``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fence = handle.getValueState("fence", "fence long")
        self.held = handle.getListState("held", HELD_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("offset")
        stored = self.fence.get()
        if stored is None:
            own = batch["offset"][batch["own"]]
            if own.empty:
                self.held.appendList([_plain(row) for row in batch[RECORD].itertuples(index=False)])
                return
            stored = (int(own.iloc[0]),)
            self.fence.update(stored)
            yield from self._released(key[0], stored[0])
        for at in range(0, len(batch), PART_ROWS):
            yield _frame(key[0], batch[RECORD].iloc[at : at + PART_ROWS], stored[0])

    def _released(self, partition: int, fence: int) -> Iterator[pd.DataFrame]:
        part: list[tuple] = []
        for row in self.held.get():
            part.append(tuple(row))
            if len(part) == PART_ROWS:
                yield _frame(partition, pd.DataFrame(part, columns=RECORD), fence)
                part = []
        if part:
            yield _frame(partition, pd.DataFrame(part, columns=RECORD), fence)
        self.held.clear()


def _plain(row: tuple) -> tuple:
    offset, time_us, key, value = row
    none = lambda v: None if v is None or v is pd.NA else bytes(v)
    return int(offset), int(time_us), none(key), none(value)


def _frame(partition: int, rows: pd.DataFrame, fence: int) -> pd.DataFrame:
    phase = np.where(rows["offset"] <= fence, "snapshot", "live")
    return rows.assign(partition=partition, fence=fence, phase=phase)[["partition", *RECORD, "fence", "phase"]]


def released(log: DataFrame, generation: str) -> DataFrame:
    """Records of the create log as they may be used: (partition, offset, time_us, key, value, fence, phase).

    Nothing of a partition comes out before the first marker of ``generation``. Then all up to it is
    the ``snapshot``, and what follows is ``live`` at once. Markers of others count as records. Once
    all input is worked off, this is ``logs.with_phase(log, generation, first=True)`` without its
    waiting partitions.
    """
    own = codec.classify_marker(F.col("key"), F.col("headers"), generation) == "MY_MARKER"
    rows = log.where(F.col("topic") == S.CREATE_TOPIC).select(
        "partition", "offset", F.unix_micros("timestamp").alias("time_us"), "key", "value", F.coalesce(own, F.lit(False)).alias("own")
    )
    return rows.groupBy("partition").transformWithStateInPandas(FenceProcessor(), OUTPUT_SCHEMA, "append", "None")
