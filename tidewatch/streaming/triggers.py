"""Trigger cooldown that survives restarts: the last fired time is state of the stream's key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Cooldown(StatefulProcessor):
    """Fires a breach when the last fired one is at least `seconds` back."""

    def __init__(self, key: str, seconds: float):
        self.key, self.micros = key, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_fired", "micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # Only the rows of this micro-batch for one key, in time order.
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        for micros in batch["ts"].astype("datetime64[us]").astype("int64"):
            fires = self.micros <= 0 or last is None or micros - last >= self.micros
            last = micros if fires else last
            fired.append(fires)
        if last is not None:
            self.last.update((int(last),))
        yield batch.assign(fired=fired)[[self.key, "id", "ts", "fired"]]

    def close(self) -> None:
        pass


def fire(breaches: DataFrame, key: str, seconds: float) -> DataFrame:
    """`breaches` has the key, `id` and `ts`; adds `fired`."""
    schema = T.StructType(
        [breaches.schema[key], breaches.schema["id"], breaches.schema["ts"], T.StructField("fired", T.BooleanType())]
    )
    return breaches.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Cooldown(key, seconds), outputStructType=schema, outputMode="append", timeMode="none"
    )
