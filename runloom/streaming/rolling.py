"""Rolling percentiles on an unbounded stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runloom.functions.rolling import sliding_percentiles
from runloom.operators.series import ROLLING, ROLLING_ROWS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastValues(StatefulProcessor):
    """Keeps the last values of a key; its state never exceeds ``rows`` numbers."""

    def __init__(self, key: str, order: Sequence[str], value: str, rows: int):
        self.key, self.order, self.value, self.rows = key, list(order), value, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", T.StructType([T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch is bounded by the source's limit per trigger.
        new = pd.concat(rows).sort_values(self.order, kind="stable")
        earlier = [row[0] for row in self.last.get()] if self.last.exists() else []
        held = np.asarray(earlier[-(self.rows - 1):] if self.rows > 1 else [], dtype=float)
        values = np.concatenate([held, new[self.value].to_numpy(dtype=float)])
        results = sliding_percentiles(values, self.rows, list(ROLLING.values()), skip=len(held))
        self.last.put([(float(v),) for v in values[-self.rows:]])
        out = new[[*self.order, self.value]].assign(**dict(zip(ROLLING, results)))
        out.insert(0, self.key, key[0])
        yield out

    def close(self) -> None:
        pass


def stream_rolling_percentiles(
    stream: DataFrame, key: str, order: Sequence[str], value: str, rows: int = ROLLING_ROWS
) -> DataFrame:
    """p50, p95 and p99 of the last ``rows`` values of each key, one output row per input row.

    Rows of a micro-batch are put in order first; across micro-batches the order
    is that of arrival. Needs the RocksDB state store (``STATE_STORE``).
    """
    fields = [stream.schema[key], *[stream.schema[c] for c in order], T.StructField(value, T.DoubleType())]
    fields += [T.StructField(name, T.DoubleType()) for name in ROLLING]
    return (
        stream.select(key, *order, value)
        .groupBy(key)
        .transformWithStateInPandas(
            _LastValues(key, order, value, rows), T.StructType(fields), "append", "none"
        )
    )
