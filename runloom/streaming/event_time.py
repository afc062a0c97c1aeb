"""Streams whose rows arrive out of order, handled in the order of their event time.

Rows wait in keyed state, in buckets of event time, until the watermark has passed their bucket. An event-time timer then hands
the bucket over, sorted. So rolling percentiles, and the pairing of begin with end marks, equal the batch form
whatever the order of arrival, as long as no row is later than the stated delay. Later rows are left out and
counted, see ``LateRows``. State is kept by the checkpoint, so a restart goes on where the stream stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from runloom.functions.columns import micros
from runloom.functions.rolling import sliding_percentiles
from runloom.operators.series import BEGIN, END, ROLLING, ROLLING_ROWS

#: Event time of a bucket: one timer and a few state entries each, and what one timer sorts at once.
GRAIN = 3_600_000

# Names that begin with an underscore do not reach a stateful processor.
_TIME, _MICROS = "row_time", "row_micros"


class LateRows(StreamingQueryListener):
    """Counts the rows that came after the watermark had passed them, by query id."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class _InOrder(StatefulProcessor):
    """Buffers a key's rows by bucket and hands each bucket to ``ordered`` when its timer fires."""

    def __init__(self, fields: Sequence[T.StructField], order: Sequence[str], grain: int):
        self.fields, self.order, self.grain = list(fields), [_MICROS, *order], grain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        bucket = T.StructField("bucket", T.LongType())
        arrays = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.fields]
        self.sizes = handle.getMapState("sizes", T.StructType([bucket]), T.StructType([T.StructField("parts", T.IntegerType())]))
        # What a micro-batch adds to a bucket is a part of its own, so nothing is written twice.
        self.parts = handle.getMapState("parts", T.StructType([bucket, T.StructField("part", T.IntegerType())]), T.StructType(arrays))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for bucket, part in frame.groupby(frame[_MICROS] // (1000 * self.grain), sort=False):
                bucket = int(bucket)
                number = self.sizes.getValue((bucket,))
                if number is None:
                    self.handle.registerTimer((bucket + 1) * self.grain)
                place = number[0] if number else 0
                self.parts.updateValue((bucket, place), tuple(_plain(part[f.name]) for f in self.fields))
                self.sizes.updateValue((bucket,), (place + 1,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = expiredTimerInfo.getExpiryTimeInMs() // self.grain - 1
        columns = [[] for _ in self.fields]
        for place in range(self.sizes.getValue((bucket,))[0]):
            for column, values in zip(columns, self.parts.getValue((bucket, place))):
                column.extend(values)
            self.parts.removeKey((bucket, place))
        self.sizes.removeKey((bucket,))
        frame = pd.DataFrame({f.name: pd.Series(c, dtype=_PANDAS.get(f.dataType, object)) for f, c in zip(self.fields, columns)})
        yield from self.ordered(key, frame.sort_values(self.order, kind="stable"))

    def ordered(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


_PANDAS = {T.DoubleType(): "float64", T.LongType(): "int64"}


def _plain(values: pd.Series) -> list:
    """Values as the state's encoder takes them; NaN in a float column stays."""
    if values.dtype == object:
        return [None if v is None or v is pd.NA else v for v in values]
    return values.tolist()


class _Rolling(_InOrder):
    """Percentiles of the last values; their state never exceeds ``rows`` numbers."""

    def __init__(self, fields, order, grain, keys, value, rows):
        super().__init__(fields, order, grain)
        self.keys, self.value, self.rows = list(keys), value, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", T.StructType([T.StructField("value", T.DoubleType())]))

    def ordered(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        earlier = [row[0] for row in self.last.get()] if self.last.exists() else []
        held = np.asarray(earlier[-(self.rows - 1):] if self.rows > 1 else [], dtype=float)
        values = np.concatenate([held, frame[self.value].to_numpy(dtype=float)])
        results = sliding_percentiles(values, self.rows, list(ROLLING.values()), skip=len(held))
        self.last.put([(float(v),) for v in values[-self.rows:]])
        yield _keyed(frame.assign(**dict(zip(ROLLING, results))), self.keys, key)


class _Pairs(_InOrder):
    """Time from a begin mark to the end mark right after it; the state is the last mark."""

    def __init__(self, fields, order, grain, keys, kind, expiry):
        super().__init__(fields, order, grain)
        self.keys, self.kind, self.expiry = list(keys), kind, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.mark = handle.getValueState("mark", T.StructType([T.StructField("kind", T.StringType()), T.StructField("at", T.LongType())]))

    def ordered(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        kind, at = self.mark.get() if self.mark.exists() else (None, 0)
        kinds = frame[self.kind].tolist()
        times = frame[_MICROS].tolist()
        self.mark.update((kinds[-1], times[-1]))
        elapsed = np.diff(np.array([at, *times], np.int64)) / 1000
        paired = np.array([a == BEGIN and b == END for a, b in zip([kind, *kinds], kinds)])
        if self.expiry is not None:
            paired &= elapsed <= self.expiry
        found = frame.assign(elapsed_ms=elapsed)[paired]
        if len(found):
            yield _keyed(found.drop(columns=self.kind), self.keys, key)


def _keyed(frame: pd.DataFrame, keys: Sequence[str], key: tuple) -> pd.DataFrame:
    for place, (name, value) in enumerate(zip(keys, key)):
        frame.insert(place, name, pd.Series([value] * len(frame), index=frame.index, dtype=object if value is None else None))
    return frame


def _in_order(stream: DataFrame, keys, ts, order, others, delay, grain, made, dropped, processor, *arguments) -> DataFrame:
    """Apply a processor to the rows of each key; the result has keys, ``_micros``, order, the others that stay and what is made."""
    # The watermark's column is an instant whatever the kind of ``ts``; a null time has no place in the order.
    timed = stream.select(*keys, micros(stream, ts).alias(_MICROS), *order, *others).where(F.col(_MICROS).isNotNull())
    watched = timed.withColumn(_TIME, F.timestamp_micros(_MICROS)).withWatermark(_TIME, delay)
    fields = [timed.schema[c] for c in (_MICROS, *order, *others)]
    kept = [timed.schema[k] for k in keys] + [f for f in fields if f.name not in dropped]
    kept += [T.StructField(name, T.DoubleType()) for name in made]
    return watched.groupBy(*keys).transformWithStateInPandas(
        processor(fields, order, grain, keys, *arguments), T.StructType(kept), "append", "eventTime"
    )


def rolling_percentiles(
    stream: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], value: str, delay: str,
    rows: int = ROLLING_ROWS, grain: int = GRAIN,
) -> DataFrame:
    """p50, p95 and p99 of the last ``rows`` values of each key in order of event time, one row per row.

    ``ts`` and then ``order`` put rows in order. A row comes out once the watermark, ``delay`` behind the newest time of all keys, has passed
    its bucket of ``grain`` milliseconds; the last rows of a stream need later rows to push it. Rows without a time are left out.
    A null value is no number and takes a place in the window. Needs the RocksDB state store (``rolling.STATE_STORE``).
    """
    given = stream.withColumn(value, F.col(value).cast("double"))
    found = _in_order(given, keys, ts, list(order), [value], delay, grain, list(ROLLING), (), _Rolling, value, rows)
    return found.drop(_MICROS)


def step_pairs(
    stream: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], kind: str, delay: str,
    expiry: int | None = None, grain: int = GRAIN,
) -> DataFrame:
    """Milliseconds from a begin mark to the end mark right after it, one row per end, with its time as ``end_micros``.

    Order, delay and buckets are as in ``rolling_percentiles``. With ``expiry`` (milliseconds) a begin mark is forgotten after so long,
    so an end that comes later has no pair. The rows come out in order, so a stateful operator that takes
    rows as they arrive, such as ``rolling.stream_rolling_percentiles``, can follow.
    """
    found = _in_order(stream, keys, ts, list(order), [kind], delay, grain, ["elapsed_ms"], (kind,), _Pairs, kind, expiry)
    return found.withColumnRenamed(_MICROS, "end_micros")
