"""Blocked scans, islands and joins against plain Python, with tiny blocks."""

import random

from pyspark.sql import functions as F

from seqlens.plans.ranges import box_pairs, interval_join
from seqlens.plans.rounds import connected_components
from seqlens.plans.scan import asof, islands, ordinal_block, ranked_positions, scan


def _rows(seed=1, n=60):
    rnd = random.Random(seed)
    rows = []
    for g in range(3):
        for p in sorted(rnd.sample(range(200), n)):
            rows.append((g, p, rnd.choice([None, 1.0, 2.0, 3.0]), rnd.choice("ab")))
    rnd.shuffle(rows)
    return rows


def test_scan_crosses_blocks(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g int, p int, v double, c string").repartition(5)
    out = scan(
        df, ["g"], ["p"], ordinal_block("p", 7), prev={"pv": F.col("p")}, nxt={"nv": F.col("p")},
        running={"s": F.coalesce("v", F.lit(0.0))}, before={"b": F.col("v")}, after={"a": F.col("v")}, number="k", total="n",
    ).collect()
    got = {(r.g, r.p): (r.pv, r.nv, r.s, r.b, r.a, r.k, r.n) for r in out}
    want = {}
    for g in range(3):
        mine = sorted(r for r in rows if r[0] == g)
        for i, r in enumerate(mine):
            past = [x[2] for x in mine[:i] if x[2] is not None]
            future = [x[2] for x in mine[i + 1:] if x[2] is not None]
            want[g, r[1]] = (
                mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None,
                sum(x[2] or 0.0 for x in mine[: i + 1]), past[-1] if past else None, future[0] if future else None, i, len(mine),
            )
    assert got == want


def test_islands_merge_over_blocks(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "g int, p int, v double, c string")
    for size in (1, 5, 1000):
        out = islands(
            df, ["g"], ["p"], ordinal_block("p", size), watch={"c": F.col("c"), "p": F.col("p")},
            same=lambda p, c: (p("c") == c("c")) & (c("p") - p("p") <= 6),
            aggs={"lo": ("min", F.col("p")), "hi": ("max", F.col("p")), "c": ("first", F.col("c")), "v": ("last", F.col("v")), "n": ("sum", F.lit(1))},
        ).collect()
        want = []
        for g in range(3):
            run = []
            for r in sorted(x for x in rows if x[0] == g):
                if run and run[-1][3] == r[3] and r[1] - run[-1][1] <= 6:
                    run.append(r)
                else:
                    if run:
                        want.append((g, run[0][1], run[-1][1], run[0][3], run[-1][2], len(run)))
                    run = [r]
            want.append((g, run[0][1], run[-1][1], run[0][3], run[-1][2], len(run)))
        key = lambda r: (r[0], r[1])
        assert sorted([tuple(r) for r in out], key=key) == sorted(want, key=key)


def test_asof_and_positions(spark):
    points = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 9.0), (2, 1.0)], "g int, t double")
    steps = spark.createDataFrame([(1, 2.0, "a"), (1, 5.0, "b"), (2, 3.0, "c")], "g int, s double, v string")
    block = lambda c: F.floor(c / 2)
    got = {(r.g, r.t): r.v for r in asof(points, steps, ["g"], "t", "s", ["v"], block).collect()}
    assert got == {(1, 0.5): None, (1, 2.0): "a", (1, 9.0): "b", (2, 1.0): None}
    strict = {(r.g, r.t): r.v for r in asof(points, steps, ["g"], "t", "s", ["v"], block, inclusive=False).collect()}
    assert strict[1, 2.0] is None
    names = [(g, f"f{i}") for g in (1, 2) for i in range(40)]
    out = ranked_positions(spark.createDataFrame(names, "g int, f string"), ["g"], ["f"], "k").collect()
    assert {(r.g, r.f): r.k for r in out} == {(g, f"f{i}"): sorted(f"f{j}" for j in range(40)).index(f"f{i}") for g in (1, 2) for i in range(40)}


def test_interval_join_touching_and_spanning(spark):
    rnd = random.Random(3)
    a = [(i % 2, i, float(x), x + rnd.choice([0.0, 3.0, 40.0])) for i, x in enumerate(rnd.choices(range(100), k=40))]
    b = [(i % 2, i, float(x), x + rnd.choice([0.0, 5.0, 25.0])) for i, x in enumerate(rnd.choices(range(100), k=40))]
    left = spark.createDataFrame(a, "g int, i int, a0 double, a1 double")
    right = spark.createDataFrame(b, "g int, j int, b0 double, b1 double")
    got = sorted((r.i, r.j) for r in interval_join(left, right, ["g"], ("a0", "a1"), ("b0", "b1"), 7.0).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_box_pairs_and_components(spark):
    rnd = random.Random(4)
    boxes = [(0, i, float(rnd.randrange(300)), float(rnd.randrange(300)), float(rnd.randrange(5, 60)), float(rnd.randrange(5, 60))) for i in range(60)]
    df = spark.createDataFrame(boxes, "g int, box_id int, x double, y double, w double, h double")
    touch = lambda a, b: a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]
    pairs = box_pairs(df, ["g"], "box_id", 32.0)
    assert sorted((r.id_a, r.id_b) for r in pairs.collect()) == sorted(
        (a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and touch(a, b))
    root = list(range(60))
    find = lambda i: i if root[i] == i else find(root[i])
    for a in boxes:
        for b in boxes:
            if touch(a, b):
                lo, hi = sorted((find(a[1]), find(b[1])))
                root[hi] = lo
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(30)], "g int, id_a int, id_b int")
    nodes = df.select("g", F.col("box_id").alias("id")).unionByName(spark.createDataFrame([(1, i) for i in range(31)], "g int, id int"))
    got = {(r.g, r.id): r.root for r in connected_components(pairs.select("g", "id_a", "id_b").unionByName(chain), nodes, ["g"]).collect()}
    assert got == {**{(0, i): find(i) for i in range(60)}, **{(1, i): 0 for i in range(31)}}
