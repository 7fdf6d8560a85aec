import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.chains import chain_roots
from palimpsest.functions.ordered import following, previous, running


def test_running_values_cross_slices_of_a_hot_key(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = 1 if rng.random() < 0.7 else rng.randint(2, 4)
        rows.append((key, i, rng.choice([None, rng.randint(-5, 5)])))
    frame = spark.createDataFrame(rows, "k long, i long, v long").withColumn(
        "part", F.floor(F.col("i") / 16)
    )
    out = running(
        frame, ["k"], ["i"], "part",
        total=("sum", F.col("v")), top=("max", F.col("v")), seen=("last", F.col("v")),
    )
    out = previous(out, ["k"], ["i"], "part", before=F.col("v"))
    out = following(out, ["k"], ["i"], "part", after=F.col("v"))
    got = {r.i: r for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        total, top, seen = None, None, None
        for n, (_, i, v) in enumerate(own):
            if v is not None:
                total, seen = (total or 0) + v, v
                top = v if top is None else max(top, v)
            r = got[i]
            assert (r.total, r.top, r.seen) == (total, top, seen)
            assert r.before == (own[n - 1][2] if n else None)
            assert r.after == (own[n + 1][2] if n + 1 < len(own) else None)


def test_chain_roots_and_cycles(spark):
    rows = [(i, i - 1 if i % 37 else None) for i in range(100)] + [(500, 499)]
    got = {r.id: (r.root, r.depth) for r in chain_roots(
        spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {**{i: (i - i % 37, i % 37) for i in range(100)}, 500: (500, 0)}
    for n in (1, 2, 3, 6, 7, 33, 70):
        line = [(i, i - 1 if i else None) for i in range(n)] + [(1000 + i, None) for i in range(10)]
        got = {r.id: (r.root, r.depth) for r in chain_roots(spark.createDataFrame(line, "id long, parent long")).collect()}
        assert got == {**{i: (0, i) for i in range(n)}, **{1000 + i: (1000 + i, 0) for i in range(10)}}
    star = spark.range(100_000).selectExpr("id", "CASE WHEN id > 0 THEN 0L END AS parent")
    assert chain_roots(star).where("root = 0").count() == 100_000
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long")
    with pytest.raises(ValueError):
        chain_roots(loop)
