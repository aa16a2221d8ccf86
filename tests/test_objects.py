"""Objects put into documents against one command after another."""

import random

from quire.operators import objects as O
from quire.operators.objects import CHART

COMMANDS = f"doc_id long, section long, seq long, op string, block long, rows array<array<string>>, content binary, width long, height long, chart {CHART}"
BLOCKS = "doc_id long, section long, block long, kind string, text string"
IMAGES = "doc_id long, section long, block long, pos int, bin_ref string, width long, height long"


def bars(kind="bar", categories=("a", "b"), series=(("s", [1.0, 2.0]),), width=None, height=None):
    return (kind, categories and list(categories), series and list(series), width, height)


def command(seq, op, block, *, doc=1, section=0, rows=(("x",),), content=b"png", width=30, height=40, chart=None):
    return (doc, section, seq, op, block, rows and [list(r) for r in rows], content, width, height, chart or bars())


def frames(spark, commands, blocks, images, bins):
    return spark.createDataFrame(commands, COMMANDS), spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(images, IMAGES), spark.createDataFrame(bins, "doc_id long, bin_ref string")


def test_statuses(spark):
    want = [
        ("ok", command(0, "insert_table", 0)), ("empty_table", command(1, "insert_table", 0, rows=())), ("empty_table", command(2, "insert_table", 0, rows=None)), ("empty_table", command(3, "insert_table", 9, rows=((), ()))),
        ("empty_bytes", command(4, "insert_image", 0, content=b"")), ("empty_bytes", command(5, "insert_image", 0, content=None)), ("ok", command(6, "insert_image", 3)), ("out_of_range", command(7, "insert_image", 4)), ("out_of_range", command(8, "insert_image", -1)), ("out_of_range", command(9, "insert_image", None)),
        ("ok", command(10, "insert_chart", 1, chart=bars(" PIE "))), ("chart_kind", command(11, "insert_chart", 1, chart=bars("radar"))), ("chart_kind", command(12, "insert_chart", 1, chart=bars(None))), ("no_categories", command(13, "insert_chart", 1, chart=bars(categories=()))), ("no_series", command(14, "insert_chart", 1, chart=bars(series=None))),
        ("ragged", command(15, "insert_chart", 1, chart=bars(series=(("s", [1.0, 2.0]), ("t", [1.0]))))), ("ragged", command(16, "insert_chart", 1, chart=bars(series=(("s", None),)))), ("no_section", command(17, "insert_chart", 0, section=5)),
        ("ok", command(18, "resize_image", 0)), ("bad_size", command(19, "resize_image", 0, width=0)), ("bad_size", command(20, "resize_image", 0, height=None)), ("out_of_range", command(21, "resize_image", 3)), ("not_paragraph", command(22, "resize_image", 1)), ("no_image", command(23, "resize_image", 2)), ("bad_op", command(24, "paint", 0)), ("bad_op", command(25, None, 0)),
    ]
    blocks = [(1, 0, k, kind, "t") for k, kind in enumerate(["paragraph", "table", "paragraph"])]
    c, b, i, bins = frames(spark, [w[1] for w in want], blocks, [(1, 0, 0, 2, "img1", 1, 1), (1, 0, 0, 1, "img2", 5, 5)], [(1, "img1"), (1, "img2")])
    assert {r.seq: r.status for r in O.checked(c, b, i).collect()} == {w[1][2]: w[0] for w in want}
    after, images = O.placed_objects(c, b, i, bins)
    assert [(r.pos, r.block, r.made, r.kind) for r in after.orderBy("pos").collect()] == [(0, None, 0, "table"), (1, 0, None, "paragraph"), (2, None, 10, "paragraph"), (3, 1, None, "table"), (4, 2, None, "paragraph"), (5, None, 6, "paragraph")]
    assert sorted((r.pos, r["at"], r.bin_ref, r.width, r.height) for r in images.collect() if r.bin_ref) == [(1, 1, "img2", 30, 40), (1, 2, "img1", 1, 1), (5, 0, "img3", 30, 40)]
    assert [(r.pos, r.width, r.height) for r in images.where("bin_ref is null").collect()] == [(2, 30000, 19500)]


def test_names_one_after_another(spark):
    rng, inserts, bins, want = random.Random(5), [], [], {}
    for doc in range(40):
        names = [rng.choice([f"img{rng.randint(0, 14)}", "img05", "imgx", "logo", None]) for _ in range(rng.choice([0, 1, 3, 8]))]
        bins += [(doc, n) for n in names]
        for seq in rng.sample(range(30), rng.randint(0, 9)):
            inserts.append((doc, seq))
        for seq in sorted(s for d, s in inserts if d == doc):
            n = len(names) + 1
            while f"img{n}" in names:
                n += 1
            names.append(f"img{n}")
            want[doc, seq] = f"img{n}"
    got = O.bin_refs(spark.createDataFrame(inserts, "doc_id long, seq long").repartition(3), spark.createDataFrame(bins, "doc_id long, bin_ref string")).collect()
    assert {(r.doc_id, r.seq): r.bin_ref for r in got} == want and len(got) == len(want)


def test_nothing_to_do(spark):
    blocks = [(1, 0, 0, "paragraph", "t")]
    after, images = O.placed_objects(*frames(spark, [], blocks, [(1, 0, 0, 0, "img1", 1, 2)], []))
    assert [(r.pos, r.block, r.kind, r.text) for r in after.collect()] == [(0, 0, "paragraph", "t")]
    assert [(r.pos, r.bin_ref, r.width, r.height) for r in images.collect()] == [(0, "img1", 1, 2)]
