"""Edit scripts against a replay, command by command."""

import random

import pytest

from quire.operators import script as S

COMMANDS = "doc_id string, section long, seq long, op string, block long, position string, text string"
BLOCKS = "doc_id string, section long, block long, text string"
ROWS = "doc_id string, section long, block long, seq long, at long, count long, rows long"


def replay(blocks, commands):
    """(indices, texts after all): blocks and commands of one section."""
    now, changes, indices = list(blocks), [], []
    for op, block, position, text in commands:
        n = len(blocks)
        point = {"start": 0, "end": n, "before": min(block, n), "after": min(block + 1, n)}[position] if op == "insert" else block
        index = max(0, point + sum(d > 0 and p <= point for p, d in changes) - sum(d < 0 and p < point for p, d in changes))
        indices.append(index)
        if op == "insert":
            if index <= len(now):
                now.insert(index, text)
            changes.append((point, 1))
        elif op == "delete":
            if index < len(now):
                del now[index]
            changes.append((point, -1))
        elif index < len(now):
            now[index] = text
    return indices, now


def check(spark, scripts):
    """scripts: {doc: (blocks, commands)}"""
    commands = spark.createDataFrame([(d, 0, 3 * k, *c) for d, (_, cs) in scripts.items() for k, c in enumerate(cs)], COMMANDS).repartition(4)
    blocks = spark.createDataFrame([(d, 0, k, t) for d, (bs, _) in scripts.items() for k, t in enumerate(bs)], BLOCKS)
    found = {(r["doc_id"], r["seq"]): r["index"] for r in S.resolved(commands, blocks).collect()}
    after = {}
    for r in S.applied(commands, blocks).orderBy("doc_id", "pos").collect():
        own = after.setdefault(r["doc_id"], [])
        assert r["pos"] == len(own)
        own.append(r["text"])
    for d, (bs, cs) in scripts.items():
        indices, texts = replay(bs, cs)
        assert [found[d, 3 * k] for k in range(len(cs))] == indices, d
        assert after.get(d, []) == texts, d


def test_cases(spark):
    para = [f"p{k}" for k in range(5)]
    put = lambda block, text, position="after": ("insert", block, position, text)
    check(
        spark,
        {
            "one behind its anchor": (para, [put(1, "table")]),
            "several in one section": (para, [put(0, "a"), put(2, "b"), put(2, "c"), put(4, "d"), put(0, "s", "start"), put(0, "e", "end")]),
            "taken, then put": (para, [("delete", 1, None, None), put(2, "a"), put(1, "b"), put(1, "c", "before")]),
            "set among changes": (para, [put(0, "a", "before"), ("set", 2, None, "new"), ("delete", 0, None, None), ("set", 2, None, "newer"), ("set", 4, None, "last")]),
            "taken twice": (para, [("delete", 1, None, None), ("delete", 1, None, None), ("set", 3, None, "x"), put(2, "y")]),
            "set after it went": (para, [("delete", 2, None, None), ("set", 2, None, "x")]),
            "set before it goes": (para, [("set", 2, None, "x"), ("delete", 2, None, None)]),
            "behind the last": (para, [("set", 9, None, "x"), put(9, "y"), ("delete", 7, None, None), put(4, "z")]),
            "nothing there": ([], [put(0, "a"), ("set", 0, None, "b"), put(3, "c", "before")]),
            "no script": (para, []),
        },
    )


@pytest.mark.parametrize("wild", [False, True])
def test_random_scripts(spark, wild):
    rng = random.Random(wild)
    scripts = {}
    for d in range(25):
        n = rng.randint(0, 30)
        commands, gone = [], set()
        for k in range(rng.randint(0, 40)):
            block, op = rng.randrange(n + 3 if wild else max(n, 1)), rng.choice(["insert", "insert", "delete", "set"])
            if not wild and op != "insert" and (block in gone or block >= n):
                continue
            gone |= {block} if op == "delete" else set()
            commands.append((op, block, rng.choice(["after", "before", "start", "end"]) if op == "insert" else None, f"c{k}"))
        scripts[f"d{d}"] = ([f"b{k}" for k in range(n)], commands)
    check(spark, scripts)


def test_thousands_of_commands(spark):
    rng = random.Random(6)
    blocks, gone, commands = [f"b{k}" for k in range(3000)], set(), []
    for k in range(4000):
        block, op = rng.randrange(3000), rng.choice(["insert", "delete", "set"])
        if op == "insert" or block not in gone:
            gone |= {block} if op == "delete" else set()
            commands.append((op, block, rng.choice(["after", "before"]) if op == "insert" else None, f"c{k}"))
    check(spark, {"long": (blocks, commands)})


def test_rows_of_one_table(spark):
    rng = random.Random(2)
    rows = [("d", 0, b, s, None if rng.random() < 0.3 else rng.randint(0, 6), rng.randint(1, 3), 6) for b in range(4) for s in range(rng.randint(1, 9))]
    got = {(r["block"], r["seq"]): r["index"] for r in S.row_points(spark.createDataFrame(rows, ROWS)).collect()}
    for b in range(4):
        done = []
        for _, _, _, s, at, count, n in sorted(r for r in rows if r[2] == b):
            index = n + sum(c for _, c in done) if at is None else at + sum(c for i, c in done if i <= at)
            assert got[b, s] == index
            done.append((index, count))
