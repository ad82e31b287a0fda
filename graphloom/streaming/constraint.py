"""Unique identifiers, kept while rows are written: a stream routes repeated ones to a table of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accepted(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A stream of rows with a flag __accepted: true for the first row of a key that has come, the smallest by order of
    those that come in one batch, and for every row with a null key, as null equals nothing.

    Each key's state says that it is taken; it is kept on disk and never expires. The rows of a key are gone through part by
    part, so that one with very many is not held.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def judge(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = pd.isna(key_[0])
        held = None
        for pdf in parts:
            if free or state.exists:
                yield pdf.assign(__accepted=bool(free))
                continue
            pdf = (pdf if held is None else pd.concat([held, pdf])).sort_values(order, kind="stable", na_position="first")
            held = pdf.iloc[:1]
            yield pdf.iloc[1:].assign(__accepted=False)
        if held is not None:
            state.update((True,))
            yield held.assign(__accepted=True)

    return rows.groupBy(key).applyInPandasWithState(judge, f"{kinds}, __accepted boolean", "taken boolean", "append", GroupStateTimeout.NoTimeout)


def unique_stream(rows: DataFrame, folder: str, marks: str, key: str, order: list[str]) -> StreamingQuery:
    """Write rows under folder/accepted and, those that repeat a key, under folder/rejected, a folder for each batch; a batch
    that runs again writes its own anew. The stream should be of a session that keeps state in ROCKSDB."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, part in (("accepted", batch.where("__accepted")), ("rejected", batch.where("not __accepted"))):
            part.drop("__accepted").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return accepted(rows, key, order).writeStream.foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()

