"""Editing sessions as streams: documents with undo, redo and proposals, and their content at any revision."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.functions.asof import as_of
from quire.plans.registry import query
from quire.sources.adapters import table

LOG = "doc_id long, seq long, status string, revision long, undo_depth long, redo_depth long, blocks array<long>, texts array<string>"
_STEP = "size long, blocks array<long>, before array<string>, after array<string>"
#: Steps that stay whatever the budget, and how many are kept (fixed values).
FLOOR, LIMIT = 4, 100


class _Session(StatefulProcessor):
    """One document: its blocks, both stacks and the proposals are maps, so that a command touches only what it changes."""

    def __init__(self, limit: int, budget: int):
        self.limit, self.budget = limit, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "revision long, low long, top long, redo long, size long, held long")
        self.blocks = handle.getMapState("blocks", "block long", "text string")
        self.undo = handle.getMapState("undo", "at long", _STEP)
        self.redo = handle.getMapState("redo", "at long", _STEP)
        self.pending = handle.getMapState("pending", "name string", "blocks array<long>, texts array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        commands = sorted((tuple(r) for f in rows for r in f[["seq", "command", "name", "blocks", "texts"]].itertuples(index=False)), key=lambda r: r[0])
        self.revision, self.low, self.top, self.above, self.size, self.held = self.meta.get() if self.meta.exists() else (0, 0, 0, 0, 0, 0)
        out = []
        for seq, command, name, blocks, texts in commands:
            status, changed = self._run(command, name, blocks, texts)
            out.append((key[0], seq, status, self.revision, self.top - self.low, self.above, list(changed), list(changed.values())))
        self.meta.update((self.revision, self.low, self.top, self.above, self.size, self.held))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "status", "revision", "undo_depth", "redo_depth", "blocks", "texts"])

    def _run(self, command: str, name: str | None, blocks: Any, texts: Any) -> tuple[str, dict[int, str | None]]:
        if command in ("edit", "propose"):
            changes = _changes(blocks, texts)
            if not changes or (command == "propose" and name is None):
                return "refused", {}
            if command == "edit":
                return "done", self._edit(changes)
            self.pending.updateValue((name,), (list(changes), list(changes.values())))
            return "pending", {}
        if command in ("commit", "discard"):
            if name is None or not self.pending.containsKey((name,)):
                return "unknown", {}
            held = self.pending.getValue((name,))
            self.pending.removeKey((name,))
            return "done", self._edit(dict(zip(held[0], held[1], strict=True))) if command == "commit" else {}
        if command == "undo" and self.top > self.low:
            self.top -= 1
            size, at, before, after = self._pop(self.undo, self.top)
            self.held -= size
            self.redo.updateValue((self.above,), (size, at, before, after))
            self.above += 1
            return "done", self._move(dict(zip(at, before, strict=True)))
        if command == "redo" and self.above:
            self.above -= 1
            _, at, before, after = self._pop(self.redo, self.above)
            self._push(at, before, after)
            return "done", self._move(dict(zip(at, after, strict=True)))
        return ("nothing" if command in ("undo", "redo") else "unknown"), {}

    def _pop(self, stack: Any, at: int) -> tuple:
        step = stack.getValue((at,))
        stack.removeKey((at,))
        return tuple(step)

    def _text(self, block: int) -> str | None:
        return self.blocks.getValue((block,))[0] if self.blocks.containsKey((block,)) else None

    def _edit(self, changes: dict[int, str | None]) -> dict[int, str | None]:
        self._push(list(changes), [self._text(b) for b in changes], list(changes.values()))
        while self.above:
            self.above -= 1
            self.redo.removeKey((self.above,))
        return self._move(changes)

    def _push(self, at: list[int], before: list[str | None], after: list[str | None]) -> None:
        """A step costs the bytes of the document that it began from; the oldest go, first by number, then by bytes."""
        self.undo.updateValue((self.top,), (self.size, list(at), list(before), list(after)))
        self.top, self.held = self.top + 1, self.held + self.size
        while (self.limit and self.top - self.low > self.limit) or (self.budget and self.held > self.budget and self.top - self.low > FLOOR):
            self.held -= self._pop(self.undo, self.low)[0]
            self.low += 1

    def _move(self, changes: dict[int, str | None]) -> dict[int, str | None]:
        for block, text in changes.items():
            self.size += len((text or "").encode()) - len((self._text(block) or "").encode())
            if text is not None:
                self.blocks.updateValue((block,), (text,))
            elif self.blocks.containsKey((block,)):
                self.blocks.removeKey((block,))
        self.revision += 1
        return changes

    def close(self) -> None:
        pass


def _changes(blocks: Any, texts: Any) -> dict[int, str | None] | None:
    """Blocks with their new texts, the last for each; None if the lists do not fit or a block is none."""
    if blocks is None or texts is None or len(blocks) != len(texts) or any(b is None or b != b or b < 0 for b in blocks):
        return None
    return {int(b): t for b, t in zip(blocks, texts, strict=True)}


def edit_sessions(commands: DataFrame, *, limit: int = LIMIT, budget: int = 0) -> DataFrame:
    """A stream (doc_id, seq, command, name, blocks, texts) to (doc_id, seq, status, revision, undo_depth, redo_depth, blocks, texts): what each command changed.

    edit sets the texts of blocks, all or none (a null text removes a block); propose holds such changes under a name
    until commit makes them one edit or discard drops them; undo and redo step through edits. Each change bumps the
    revision. The limit counts steps, the budget bytes (0: none); the budget leaves the last four. Statuses: done,
    pending, nothing (no step), refused (no or ill-formed changes), unknown (command or proposal). Commands of a document
    are taken by seq within a micro-batch. The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    return commands.groupBy("doc_id").transformWithStateInPandas(_Session(limit, budget), LOG, "Append", "None")


def content_at(log: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, revision) with the blocks (block, text) of the document at that revision; log is (doc_id, revision, block, text), null where a block goes.

    The log is the snapshot table: each block's last change at or before a revision counts, found by an as-of join.
    """
    blocks = log.select("doc_id", "block").distinct()
    left = asked.select("doc_id", "revision").distinct().join(blocks, "doc_id")
    return as_of(left, log.select("doc_id", "block", "revision", "text"), ["doc_id", "block"], "revision", ["text"], width=1 << 16).where("text is not null")


def changes_of(sessions: DataFrame) -> DataFrame:
    """(doc_id, revision, block, text) of what sessions changed."""
    each = sessions.where("size(blocks) > 0").select("doc_id", "revision", F.explode(F.arrays_zip("blocks", "texts")).alias("c"))
    return each.select("doc_id", "revision", F.col("c.blocks").alias("block"), F.col("c.texts").alias("text"))


@query("""WITH log AS (SELECT user_id AS doc_id, event_id AS revision, event_id % 7 AS block, CASE WHEN event_type <> 'error' THEN event_type || event_id END AS text FROM events), b AS (SELECT DISTINCT doc_id, block FROM log), q AS (SELECT DISTINCT doc_id, revision, b.block FROM log JOIN b USING (doc_id))
SELECT q.doc_id, q.revision, q.block, log.text FROM q ASOF JOIN log ON q.doc_id = log.doc_id AND q.block = log.block AND q.revision >= log.revision WHERE log.text IS NOT NULL""")
def history_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") != "error", F.concat("event_type", F.col("event_id").cast("string")))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("revision"), (F.col("event_id") % 7).alias("block"), text.alias("text"))
    return content_at(log, log)
