"""The status machine of concepts as a stream (T4, W1), with state that Spark keeps by concept.

Counters and status are one value, the sessions seen a map, transitions a list; a timer tells
of concepts that have had no event for a while. State is restored from the checkpoint, so a
restarted stream goes on where it stopped; a machine can also start from states that a batch
replay has left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, confidence int, failures int, evidence int, transitions int, sessions int, last_seq long, late int, seen_ms long"
OUTPUT = f"concept string, {STATE}, idle boolean"
FIRST = ("candidate", 1, 0, 0, 0, 0, -1, 0, 0)


def next_status(status: str, kind: str, sessions: int, confidence: int, evidence: int, fitness: tuple[int, int, float] | None = None) -> str:
    """The status after an event, given the counters with it and (successes, failures, score)."""
    good, bad, score = fitness or (0, 0, 0.0)
    known = good + bad > 0
    if kind == "deprecation":
        return "deprecated"
    if known and score < 0.60 and bad >= (5 if confidence >= 4 or evidence >= 10 else 3):
        return "needs_review"
    if status == "needs_review":
        return "validated" if known and score >= 0.80 and good >= 2 and evidence >= 2 else "needs_review"
    if sessions >= 5 and confidence >= 4:
        return "canonical"
    if evidence >= 2 or status == "validated":
        return "validated"
    return "emerging" if sessions >= 1 and evidence >= 1 else "candidate"


class StatusMachine(StatefulProcessor):
    """Takes events (concept, seq, session_id, event_type, has_evidence, ts_ms) in order of seq within a
    micro-batch. An event that is not after the last one taken is late: it is counted, not applied."""

    def __init__(self, idle_ms: int = 0, history_ttl_ms: int | None = None):
        self.idle_ms, self.history_ttl_ms = idle_ms, history_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.seen = handle.getMapState("sessions", "session_id string", "first_seq long")
        self.history = handle.getListState("history", "seq long, from_status string, to_status string, trigger string, session_id string", self.history_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, conf, fails, evidence, moves, sessions, last, late, seen_ms = self.state.get() if self.state.exists() else FIRST
        batch = pd.concat(list(rows)).sort_values("seq")
        known = {k[0] for k in self.seen.keys()} if sessions else set()
        moved, old_ms = [], seen_ms
        for seq, session, kind, has_evidence, ms in zip(batch["seq"], batch["session_id"], batch["event_type"], batch["has_evidence"], batch["ts_ms"], strict=True):
            if seq <= last:
                late += 1
                continue
            last, seen_ms = int(seq), max(seen_ms, int(ms))
            if session not in known:
                known.add(session)
                self.seen.updateValue((session,), (last,))
                sessions += 1
            evidence += bool(has_evidence)
            if kind == "validation":
                conf = min(5, conf + 1)
            elif kind == "failure":
                conf, fails = max(1, conf - 1), fails + 1
            after = next_status(status, kind, sessions, conf, evidence)
            if after != status:
                moved.append((last, status, after, kind, session))
                moves, status = moves + 1, after
        if moved:
            self.history.appendList(moved)
        self.state.update((status, conf, fails, evidence, moves, sessions, last, late, seen_ms))
        if self.idle_ms and seen_ms != old_ms:
            if old_ms:
                self.handle.deleteTimer(old_ms + self.idle_ms)
            self.handle.registerTimer(seen_ms + self.idle_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No event for ``idle_ms``: the state is told once more, as idle."""
        if self.state.exists():
            yield self._row(key, True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Starts from a replayed state: its counters, and its sessions as a list."""
        r = initialState.iloc[0]
        for s in r["session_ids"]:
            self.seen.updateValue((s,), (int(r["last_seq"]),))
        self.state.update((r["status"], int(r["confidence"]), int(r["failures"]), int(r["evidence"]), int(r["transitions"]), len(r["session_ids"]), int(r["last_seq"]), 0, 0))

    def _row(self, key, idle: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *self.state.get(), idle)], columns=["concept", "status", "confidence", "failures", "evidence", "transitions", "sessions", "last_seq", "late", "seen_ms", "idle"])

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_stream(events: DataFrame, idle_ms: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """T4: a row per concept of each micro-batch with its state after it, from a stream of (concept, seq, session_id,
    event_type, evidence, ts). Needs the RocksDB state store. With ``idle_ms`` the stream has a watermark on
    ts, and rows marked idle tell of concepts that it has left behind by as much.

    ``initial`` (concept, status, confidence, failures, evidence, transitions, session_ids, last_seq)
    is taken once, when the stream first starts.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    rows = events.select("concept", "seq", "session_id", "event_type", (F.coalesce(F.length("evidence"), F.lit(0)) > 0).alias("has_evidence"), F.unix_millis("ts").alias("ts_ms"), "ts")
    if idle_ms:
        rows = rows.withWatermark("ts", "0 seconds")
    start = initial.groupBy("concept") if initial is not None else None
    return rows.groupBy("concept").transformWithStateInPandas(StatusMachine(idle_ms), OUTPUT, "Update", "EventTime" if idle_ms else "None", start)


def replayed_states(events: DataFrame) -> DataFrame:
    """The states of a batch replay, as ``status_stream`` starts from them."""
    from ..operators.lifecycle import replay

    last = events.groupBy("concept").agg(F.max("seq").alias("last_seq"))
    s = replay(events).select("concept", "s.status", "s.confidence", "s.failures", "s.evidence", "s.transitions", F.col("s.sessions").alias("session_ids"))
    return s.join(last, "concept")
