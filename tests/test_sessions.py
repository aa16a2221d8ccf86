"""Sessions against a replay with whole copies, over a restart; content at each revision."""

import random

import pytest

from quire.streaming import sessions as S

SCHEMA = "doc_id long, seq long, command string, name string, blocks array<long>, texts array<string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay:
    """Stacks of whole documents."""

    def __init__(self, limit, budget):
        self.doc, self.undo, self.redo, self.pending, self.rev, self.limit, self.budget = {}, [], [], {}, 0, limit, budget
        self.seen = {0: {}}

    @staticmethod
    def size(doc):
        return sum(len(t.encode()) for t in doc.values())

    def push(self):
        self.undo.append(self.doc)
        if self.limit and len(self.undo) > self.limit:
            del self.undo[0]
        while self.budget and sum(map(self.size, self.undo)) > self.budget and len(self.undo) > 4:
            del self.undo[0]

    def edit(self, blocks, texts):
        self.push()
        self.redo = []
        new = dict(self.doc)
        for b, t in zip(blocks, texts, strict=True):
            new[b] = t
        self.doc = {b: t for b, t in new.items() if t is not None}

    def run(self, command, name, blocks, texts):
        status, before = "done", self.rev
        fits = bool(blocks) and texts is not None and len(blocks) == len(texts) and all(b is not None and b >= 0 for b in blocks)
        if command in ("edit", "propose") and (not fits or (command == "propose" and name is None)):
            return "refused"
        if command == "propose":
            self.pending[name] = (blocks, texts)
            return "pending"
        if command in ("commit", "discard"):
            if name not in self.pending:
                return "unknown"
            held = self.pending.pop(name)
            if command == "discard":
                return "done"
            self.edit(*held)
        elif command == "edit":
            self.edit(blocks, texts)
        elif command == "undo" and self.undo:
            self.redo.append(self.doc)
            self.doc = self.undo.pop()
        elif command == "redo" and self.redo:
            new = self.redo.pop()
            self.push()
            self.doc = new
        else:
            return "nothing" if command in ("undo", "redo") else "unknown"
        self.rev = before + 1
        self.seen[self.rev] = self.doc
        return status


def commands(rng, doc, n):
    for seq in range(n):
        kind = rng.choice(["edit"] * 5 + ["undo"] * 4 + ["redo"] * 3 + ["propose", "commit", "discard", "other"])
        size = rng.choice([0, 1, 1, 2, 3])
        blocks = [rng.choice([0, 1, 2, 3, 40]) for _ in range(size)] if rng.random() < 0.95 else [None, -1][: rng.randint(1, 2)]
        texts = [rng.choice([None, "", "a", "漢字", "long " * 5]) for _ in blocks]
        yield (doc, seq, kind, rng.choice(["p", "q", None]), blocks if rng.random() < 0.97 else None, texts if rng.random() < 0.97 else texts + ["x"])


@pytest.mark.parametrize(("limit", "budget"), [(100, 0), (3, 0), (0, 60)])
def test_sessions_over_a_restart(spark, tmp_path, limit, budget):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rng = random.Random(limit + budget)
        docs = {d: list(commands(rng, d, 70)) for d in range(3)}
        for part in range(2):
            rows = [c for own in docs.values() for c in own[part * 35 : part * 35 + 35]]
            rng.shuffle(rows)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = S.edit_sessions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), limit=limit, budget=budget)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.doc_id, r.seq): (r.status, r.revision, r.undo_depth, r.redo_depth) for r in out.collect()}
    replays = {}
    for d, own in docs.items():
        replay = replays[d] = Replay(limit, budget)
        for _, seq, *command in own:
            status = replay.run(*command)
            assert got[d, seq] == (status, replay.rev, len(replay.undo), len(replay.redo)), (d, seq, command)
    assert len(got) == 210
    asked = [(d, r) for d, replay in replays.items() for r in replay.seen]
    found = {k: {} for k in asked}
    for r in S.content_at(S.changes_of(out), spark.createDataFrame(asked, "doc_id long, revision long")).collect():
        found[r.doc_id, r.revision][r.block] = r.text
    assert found == {(d, r): doc for d, replay in replays.items() for r, doc in replay.seen.items()}
