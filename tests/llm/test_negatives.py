"""Hard negatives by all products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.llm import negatives, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, anchors, positives=5, negatives_=5, low=80, scale=256):
    """rows: (id, label, vector) that take part."""
    dims = max((len(v) for _, _, v in rows), default=0)
    x = [(k, lab, np.array([int(np.floor(float(c) * scale)) for c in v] + [0] * (dims - len(v)), object)) for k, lab, v in rows]
    out = []
    for a in sorted({k for k, _, _ in x if anchors(k)}):
        _, lab, v = min((r for r in x if r[0] == a), key=lambda r: (r[1], r[2].tolist()))
        scored = sorted(((int(v @ w), k, other) for k, other, w in x if k != a), key=lambda r: (-r[0], r[1]))
        for ps, p, _ in [r for r in scored if r[2] == lab][:positives]:
            near = [(s, k) for s, k, other in scored if other != lab and low * ps <= 100 * s <= 100 * ps][:negatives_]
            out += [(a, p, i + 1, k, ps, s) for i, (s, k) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({negatives.ORACLE})").fetchall())
    assert got(queries.op12_hard_negatives(spark, d)) == want and len(want) > 20


def test_products_keep_what_may_be_best():
    rng = np.random.default_rng(3)
    for wide in (1, 3, 200, 1 << 20):
        a, x = rng.integers(-wide, wide + 1, (7, 9)), rng.integers(-wide, wide + 1, (400, 9))
        exact = a @ x.T
        none, all_ = np.full((7, 1), negatives.LEAST), np.full((7, 1), negatives.MOST)
        i, j, s = negatives.sliced_products(a, negatives.Planes(x), np.ones((7, 400), bool), none, all_, none, 4)
        assert (s == exact[i, j]).all()
        kept = np.zeros((7, 400), bool)
        kept[i, j] = True
        assert all(kept[r, exact[r] >= np.sort(exact[r])[-4]].all() for r in range(7))
        if wide > 100:
            assert len(i) < 400


def test_blocks_make_no_difference(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(rng.integers(3)), [float(v) for v in rng.normal(size=5).round(2)]) for k in range(300)]
    rows += [(k, lab, v) for k, lab, v in rows[:40]]  # repeated rows, so ties
    rows += [(1000 + k, 0, rows[k][2]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = plain(rows, lambda k: k % 10 == 0)
    assert len(want) > 100
    for parts, anchors, block in ((1, 4096, 16384), (5, 7, 32), (3, 1, 1000)):
        assert got(negatives.mine(df.repartition(parts), F.col("vec_id") % 10 == 0, anchor_block=anchors, row_block=block)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.99, 0.25]), (3, 2, [1.0]), (10, 3, [0.0, 0.0]), (11, 3, [0.0, 0.0]), (12, 1, [0.0, 0.0]), (13, 3, []), (20, 9, [1.0, 1.0]), (0, 2, [0.5, 0.5]), (-10, 1, [-1.0, -0.004])]
    bad = [(4, None, [1.0, 1.0]), (5, 1, None), (6, 1, [None, 1.0]), (7, 1, [nan, 1.0]), (8, 2, [1.0, inf]), (9, 2, [-inf, 1.0]), (None, 1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in good + bad], "vec_id long, label int, embedding array<float>, rank int, anchor string")
    asked = F.col("vec_id") % 10 == 0
    assert got(negatives.mine(df, asked)) == plain(good, lambda k: k % 10 == 0)
    assert got(negatives.mine(df.limit(0), asked)) == [] and got(negatives.mine(df, F.lit(False))) == []
    with pytest.raises(Exception, match="beyond"):
        negatives.mine(df.withColumn("embedding", F.array(F.lit(1e9))), asked).collect()
