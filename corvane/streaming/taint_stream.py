"""Taint state as a stream: per conversation, resets and what was processed.

The same rule as the batch fold, kept as keyed state: (processed, segment). Events
carry their caller's sequence number, by which a micro-batch is ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conversation_id string, seq long, progress long, reset boolean, segment int"
STATE = "processed long, segment int"


def _turns(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    processed, segment = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    resets, segments = [], []
    for progress, marks in zip(rows["progress"], rows["marks"]):
        reset = segment == 0 or progress <= processed
        if reset:
            processed, segment = 0, segment + 1
        if marks:
            processed = max(processed, int(progress))
        resets.append(bool(reset))
        segments.append(segment)
    state.update((int(processed), int(segment)))
    yield pd.DataFrame({"conversation_id": str(key[0]), "seq": rows["seq"], "progress": rows["progress"], "reset": resets, "segment": segments})


def turn_stream(events: DataFrame) -> DataFrame:
    """Streaming (conversation_id string, seq, progress, marks) to turns with reset and segment."""
    keyed = events.groupBy("conversation_id")
    return keyed.applyInPandasWithState(_turns, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(events: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what there is and writes the turns to ``path``."""
    out = turn_stream(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    out.trigger(availableNow=True).start().awaitTermination()
