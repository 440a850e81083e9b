"""Guard and gate over one keyed state: what tools returned, and what calls may do, as a stream.

Events of a conversation are tool outputs and tool calls. State per conversation is the
turn (what was processed, the segment) as a value, and the segment's records (matching form,
source, flags) as a list that only grows until a turn resets it, so a micro-batch writes
what it adds and no more. An output is guarded only if its position lies past what was
processed, is recorded as untrusted and marks progress; a call begins a turn without
marking, and each of its arguments is traced to the records before it. A failing event
passes through, is marked and is counted by ``observe``; ``FailOpen`` reads the counts of a
stream, an ``Observation`` those of a batch. Events carry their caller's sequence number,
by which a micro-batch is ordered. State of sessions that have ended goes after ``ttl_ms``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from corvane.functions.lattice import UNTRUSTED, USER
from corvane.functions.text import MIN_STRING_MATCH

#: One row per output, and per argument of a call (one without an argument for a call that has none).
OUT = "conversation_id string, seq long, kind string, arg string, segment int, reset boolean, tier int, flags string, sources string, passed boolean, failed boolean"
#: ``names`` are a call's arguments; ``needles`` their matching forms and ``owners`` whose each is.
EVENT = (
    "conversation_id string, seq long, kind string, progress long, position long, source string, norm string, flags array<string>, "
    "names array<string>, owners array<string>, needles array<string>"
)
TURN, RECORD = "processed long, segment int", "source string, norm string, flags array<string>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAME = "ledger"


def _listed(value) -> list:
    return [] if value is None else list(value)


class Session:
    """One conversation: a turn resets where its progress is not above what was processed."""

    def __init__(self, processed: int = 0, segment: int = 0, records: list | None = None) -> None:
        self.processed, self.segment, self.records = processed, segment, records or []
        self.kept = len(self.records)  # of the records, so many are in the state already

    def begin(self, progress: int) -> bool:
        reset = self.segment == 0 or progress <= self.processed
        if reset:
            self.processed, self.segment, self.records, self.kept = 0, self.segment + 1, [], -1
        return reset

    def output(self, position: int, progress: int, source: str, norm: str, flags: list[str]) -> tuple[bool, bool]:
        """(reset, recorded) of a tool output at ``position`` of a history of ``progress`` messages."""
        reset = self.begin(progress)
        fresh = position > self.processed
        if fresh:
            self.records.append((source, norm, flags))
        self.processed = max(self.processed, progress)
        return reset, fresh

    def trace(self, needles: list[str]) -> tuple[int, list[str], list[str]]:
        """(tier, flags, sources) of an argument with these matching forms."""
        hits = [r for r in self.records if any(n in r[1] for n in needles if len(n) >= MIN_STRING_MATCH)]
        flags = list(dict.fromkeys(f for r in hits for f in r[2]))
        sources = list(dict.fromkeys(r[0] for r in hits)) or ["session://user-turn"]
        return UNTRUSTED if hits else USER, flags, sources

    def events(self, key: str, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of ``OUT`` for a conversation's next events."""
        out = []
        for e in rows.sort_values("seq", kind="stable").itertuples():
            row = lambda arg, reset, tier, flags, sources, passed, failed=False: out.append((key, e.seq, e.kind, arg, self.segment, reset, tier, ",".join(flags), ",".join(sources), passed, failed))  # noqa: B023, E731
            try:
                if e.kind == "output":
                    if not isinstance(e.norm, str):
                        raise ValueError("an output without evidence")
                    flags = _listed(e.flags)
                    reset, fresh = self.output(int(e.position), int(e.progress), e.source, e.norm, flags)
                    row(None, reset, UNTRUSTED, flags if fresh else [], [e.source] if fresh else [], not fresh)
                else:
                    reset = self.begin(int(e.progress))
                    own: dict[str, list[str]] = {}
                    for owner, needle in zip(_listed(e.owners), _listed(e.needles)):
                        own.setdefault(owner, []).append(needle)
                    for name in _listed(e.names) or [None]:
                        row(name, reset, *self.trace(own.get(name, [])), False)
            except (TypeError, ValueError, AttributeError):  # an event without what its kind needs
                row(None, False, USER, [], [], True, True)
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


class Ledger(StatefulProcessor):
    """Sessions kept as a value (the turn) and a list (the records)."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", TURN, self.ttl_ms)
        self.records = handle.getListState("records", RECORD, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn = self.turn.get() if self.turn.exists() else (0, 0)
        records = [(r[0], r[1], _listed(r[2])) for r in self.records.get()] if self.records.exists() else []
        session = Session(int(turn[0]), int(turn[1]), records)
        out = session.events(str(key[0]), pd.concat(list(rows)))
        self.turn.update((session.processed, session.segment))
        if session.kept < 0:  # the segment began in this batch
            self.records.clear()
        if new := session.records[max(0, session.kept) :]:
            self.records.appendList(new)
        yield out

    def close(self) -> None:
        pass


def counted(rows: DataFrame, observation: Observation | str = NAME) -> DataFrame:
    """``rows`` of ``OUT`` with named counts: events, failed (passed through unscreened), outputs seen before."""
    calls = F.count_if(F.col("kind") == "call")
    return rows.observe(observation, F.count(F.lit(1)).alias("events"), calls.alias("calls"), F.count_if("failed").alias("failed"), F.count_if(F.col("passed") & ~F.col("failed")).alias("repeated"))


class FailOpen(StreamingQueryListener):
    """Sums a stream's counts as its batches end."""

    def __init__(self, name: str = NAME) -> None:
        self.name, self.counts = name, {"events": 0, "calls": 0, "failed": 0, "repeated": 0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if (row := event.progress.observedMetrics.get(self.name)) is not None:
            for c in self.counts:
                self.counts[c] += row[c]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ledger_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming ``EVENT`` rows to rows of ``OUT``, counted. Needs the session's state store to be RocksDB."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    rows = events.groupBy("conversation_id").transformWithStateInPandas(Ledger(ttl_ms), OUT, "append", mode)
    return counted(rows)


def run_available(events: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what there is since the last run on this checkpoint and writes its rows to ``path``.

    Without a time to live: state that expires by the clock never lets such a run end.
    """
    conf = events.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = ledger_stream(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)


def ledger_batch(events: DataFrame, observation: Observation | None = None) -> DataFrame:
    """The same over a whole table: one session is folded in memory."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return Session().events(str(key[0]), rows)

    rows = events.groupBy("conversation_id").applyInPandas(run, OUT)
    return rows if observation is None else counted(rows, observation)
