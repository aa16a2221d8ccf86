"""Streams: agent events, edit history with undo and redo, and debounced autosaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.intents import agent_events

HISTORY = "doc_id long, seq long, revision long, undo_depth long, redo_depth long"


def parsed_events(lines: DataFrame) -> DataFrame:
    """A stream of text lines as typed agent events; lines that are none are left out."""
    return agent_events(lines.withColumnRenamed("value", "line")).where("type is not null")


def edit_history(commands: DataFrame, *, limit: int = 50) -> DataFrame:
    """(doc_id, seq, revision, undo_depth, redo_depth) after each command of a stream (doc_id, seq, command).

    An edit empties the redo stack and bumps the revision; undo and redo bump it if there is anything to move. The
    state of a document is two depths and a revision, however long its history.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, undo, redo = state.get if state.exists else (0, 0, 0)
        rows = []
        for seq, command in sorted((int(s), c) for f in frames for s, c in zip(f["seq"], f["command"], strict=True)):
            if command == "undo" and undo:
                revision, undo, redo = revision + 1, undo - 1, redo + 1
            elif command == "redo" and redo:
                revision, undo, redo = revision + 1, undo + 1, redo - 1
            elif command not in ("undo", "redo"):
                revision, undo, redo = revision + 1, min(limit, undo + 1), 0
            rows.append((key[0], seq, revision, undo, redo))
        state.update((revision, undo, redo))
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "revision", "undo_depth", "redo_depth"])

    return commands.groupBy("doc_id").applyInPandasWithState(step, HISTORY, "revision long, undo long, redo long", "append", GroupStateTimeout.NoTimeout)


def autosaves(edits: DataFrame, *, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(doc_id, start, end, edits): a save for each burst of edits, when the gap has passed."""
    return edits.withWatermark("ts", late).groupBy("doc_id", F.session_window("ts", gap)).agg(F.count("*").alias("edits")).select("doc_id", "session_window.start", "session_window.end", "edits")


def event_line(kind: str, **fields: object) -> str:
    """An agent event as one line of JSON."""
    return json.dumps({"type": kind, **fields}, ensure_ascii=False) + "\n"
