"""The event bridge as a stream: units gather by thread until a run's context reaches a threshold, then are harvested.

State is kept by thread. A segment is given out once, when its threshold is reached (or a run forces it), and only
then forgotten; the sink takes it in a micro-batch that is retried as a whole, and ids of claims depend on
content alone, so a batch that is written again adds nothing new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.extract import Options, harvest
from ..operators.resolve import link_corrections, resolve, with_ids

THRESHOLD = 250_000
INPUT = "thread_id string, seq long, text string, input_tokens long, forced boolean"
OUTPUT = "thread_id string, segment long, unit_idx int, role string, text string"


def _gather(threshold: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, texts = state.get if state.exists else (0, [])
        texts = list(texts)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            if r.text is not None and r.text == r.text and str(r.text).strip():
                texts.append(r.text)
            full = pd.notna(r.input_tokens) and r.input_tokens >= threshold
            if (full or bool(r.forced)) and texts:
                yield pd.DataFrame({"thread_id": key[0], "segment": segment, "unit_idx": range(len(texts)), "role": "assistant", "text": texts})
                segment, texts = segment + 1, []
        state.update((segment, texts))

    return step


def segments(events: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Units of every finished segment; events as INPUT, a stream."""
    return events.groupBy("thread_id").applyInPandasWithState(_gather(threshold), OUTPUT, "segment long, texts array<string>", "append", GroupStateTimeout.NoTimeout)


def verified(claims: DataFrame) -> bool:
    """The gate before a segment counts as stored: every row has what a brief requires."""
    return claims.filter("id is null or text is null or topic is null or harvester is null").isEmpty()


def sink(path: str, options: Options = Options()) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: claims of the batch's segments, resolved, into Parquet under the batch's number.

    Writing a batch again overwrites its own folder, nothing else.
    """

    def write(batch: DataFrame, number: int) -> None:
        units = batch.selectExpr("concat(thread_id, '#', segment) as transcript_id", "unit_idx", "role", "text")
        claims = with_ids(harvest(units, options=options).filter("bucket = 'claim'"))
        rows = resolve(link_corrections(claims)).persist()
        if not verified(rows):
            raise ValueError(f"batch {number}: a claim lacks a required field")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")
        rows.unpersist()

    return write


def start(events: DataFrame, path: str, checkpoint: str, threshold: int = THRESHOLD, once: bool = False):
    """Starts the bridge; with once, it takes what is there and ends."""
    writer = segments(events, threshold).writeStream.foreachBatch(sink(path)).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
