"""The first writer of each fingerprint wins: state of a stream, in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import STATE

#: State with several variables needs this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the stream says of each row.
RESULT = "fingerprint string, raw_id string, is_duplicate boolean, duplicate_of_raw_id string, source_name string, recorded_at string"
_ROW = "fingerprint string, raw_id string, ordinal bigint, source_name string, recorded_at string"


class FirstWriter(StatefulProcessor):
    """For each fingerprint the row that wrote it first, for good; later rows are its duplicates.

    Of rows that come in one batch the one with the least ordinal (then raw_id) is first. It is known only
    when all have been seen, so the rows of a new fingerprint beyond the first frame wait in the state
    store, not in memory: a fingerprint that very many rows share needs no more memory than others.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "raw_id string")
        self.waiting = handle.getListState("waiting", _ROW)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if not self.first.exists():
            self.first.update((min(initialState["first_raw_id"]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()[0] if self.first.exists() else None
        held, best, spooled = None, None, False
        for frame in rows:
            if known is not None:
                yield self._told(frame, known)
                continue
            best = min([best] * (best is not None) + list(zip(frame["ordinal"], frame["raw_id"], strict=True)))
            if held is None:
                held = frame
            else:
                self.waiting.appendList([tuple(r) for r in frame[[c.split()[0] for c in _ROW.split(", ")]].astype(object).itertuples(index=False)])
                spooled = True
        if best is None:
            return
        self.first.update((best[1],))
        yield self._told(held, best[1])
        if spooled:
            part: list[tuple] = []
            for row in self.waiting.get():
                part.append(row)
                if len(part) == 10_000:
                    yield self._told(pd.DataFrame(part, columns=held.columns), best[1])
                    part = []
            if part:
                yield self._told(pd.DataFrame(part, columns=held.columns), best[1])
            self.waiting.clear()

    @staticmethod
    def _told(rows: pd.DataFrame, first: str) -> pd.DataFrame:
        duplicate = rows["raw_id"] != first
        return pd.DataFrame({"fingerprint": rows["fingerprint"], "raw_id": rows["raw_id"], "is_duplicate": duplicate, "duplicate_of_raw_id": duplicate.map({True: first, False: None}), "source_name": rows["source_name"], "recorded_at": rows["recorded_at"]})

    def close(self) -> None:
        pass


def first_writers(stream: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Tell the rows of a stream (job_fingerprint, raw_id, ordinal, source_name, collected_at) by fingerprint: RESULT.

    The first writer of a fingerprint is kept in the state store of the query's checkpoint, so that a query
    that goes on after a stop or a failure knows all earlier writers; ``state`` (a table of STATE) names
    those from before the first start. A row that comes again is no duplicate of itself.

    * Rows without a fingerprint (null or empty) are left out: they register nothing and match nothing.
    * A table instead of a stream is one batch: the same rows come out as from the stream.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.where("job_fingerprint <> ''").selectExpr("job_fingerprint as fingerprint", "raw_id", "cast(ordinal as bigint) as ordinal", "source_name", "collected_at as recorded_at")
    known = None if state is None else state.select([c.split()[0] for c in STATE.split(", ")]).groupBy("fingerprint")
    return rows.groupBy("fingerprint").transformWithStateInPandas(FirstWriter(), RESULT, "append", "none", initialState=known)


def recorded(told: DataFrame) -> DataFrame:
    """The state rows (STATE) in what :func:`first_writers` tells: one for each fingerprint that was new."""
    return told.where("not is_duplicate").selectExpr("fingerprint", "raw_id as first_raw_id", "source_name", "recorded_at")
