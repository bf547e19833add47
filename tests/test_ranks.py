"""Prefix sums, percentiles and neighbour estimates over range partitions, by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.operators import dataset_quality, exploration, metrics, ranks


@pytest.mark.parametrize("parts", [None, 1, 7, 200])
def test_running_totals(spark, parts):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), int(n), int(n) % 3) for g in "abc" for v, n in zip(rng.permutation(300)[: 250 if g == "a" else 3].round(1), rng.integers(0, 9, 300), strict=False)]
    df = spark.createDataFrame(rows, "g string, v double, n long, m long").repartition(5)
    for down in (False, True):
        for by in ((), ("g",)):
            data = df if by else df.filter("g = 'a'")
            got = {(r.g, r.v): (r.cum_n, r.cum_m) for r in ranks.running_totals(data, "v", ["n", "m"], by=by, descending=down, parts=parts).collect()}
            for g, v, _, _ in rows:
                if by or g == "a":
                    upto = [r for r in rows if r[0] == g and (r[1] >= v if down else r[1] <= v)]
                    assert got[g, v] == (sum(r[2] for r in upto), sum(r[3] for r in upto))
    assert ranks.running_totals(df.limit(0), "v", ["n"], parts=parts).count() == 0


def test_row_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(int(r), i) for i, r in enumerate(rng.integers(0, 3, 500))]
    df = spark.createDataFrame(rows, "risk int, seq int").repartition(6)
    want = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    for parts in (None, 1, 40):
        assert {(r.risk, r.seq): r.nth for r in ranks.row_numbers(df, F.desc("risk"), "seq", parts=parts).collect()} == want
    assert ranks.row_numbers(df.limit(0), "seq").count() == 0


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_group_percentiles(spark, parts):
    rng = np.random.default_rng(2)
    data = {"hot": rng.normal(size=900).round(2), "ties": np.repeat(5.0, 200), "two": np.array([1.0, 4.0]), "one": np.array([-3.0])}
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = (0, 0.01, 0.25, 0.5, 0.9, 0.99, 1)
    got = {r.g: r.q for r in ranks.group_percentiles(df, ["g"], "v", shares, parts).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        assert np.allclose(got[g], np.percentile(x, np.array(shares) * 100), atol=0, rtol=1e-14), g


def test_four_thousand_parts(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 9000), rng.permutation(9000) / 7.0
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        auc = metrics.roc_auc(df, "y", "s").first()[0]
        rank = s.argsort().argsort() + 1
        pos = int(y.sum())
        assert abs(auc - (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (9000 - pos))) < 1e-12
        assert metrics.average_precision(df, "y", "s").first()[0] > 0.4
        a, b = df.filter("y = 1"), df.filter("y = 0")
        d = dataset_quality.ks_statistic(a, b, "s").first().ks_stat
        grid = np.sort(s)
        assert abs(d - np.abs(np.searchsorted(np.sort(s[y == 1]), grid, "right") / pos - np.searchsorted(np.sort(s[y == 0]), grid, "right") / (9000 - pos)).max()) < 1e-12
        got = exploration.iqr_outliers(df, "s").first()
        assert np.allclose([got.q1, got.q3], np.percentile(s, [25, 75]))
        many = ranks.running_totals(df.select("s", F.lit(1).alias("n")), "s", ["n"], parts=4000)
        assert many._jdf.queryExecution().toString().count("CASE") < 50 and many.agg(F.max("cum_n")).first()[0] == 9000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_information(x, y, k=3):
    """Ross (2014), all distances; repeated values share a distance of 0."""
    from math import inf

    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    keep = [i for i in range(len(x)) if x[i] is not None and abs(x[i]) < inf and y[i] is not None]
    keep = [i for i in keep if sum(y[j] == y[i] for j in keep) > 1]
    u = {i: round(x[i] * 10**6) for i in keep}
    terms = 0.0
    for i in keep:
        own = sorted(abs(u[i] - u[j]) for j in keep if y[j] == y[i] and j != i)
        want = min(k, len(own))
        r = own[want - 1]
        m = sum(abs(u[i] - u[j]) < max(r, 1) for j in keep)
        terms += psi(want) - psi(len(own) + 1) - psi(m)
    return max(0.0, psi(len(keep)) + terms / len(keep)) if keep else None


def test_digamma(spark):
    from brackwater.operators import information

    got = {r.n: r.d for r in spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 1000)], "n long").select("n", information.digamma(F.col("n")).alias("d")).collect()}
    for n, d in got.items():
        assert abs(d - (-0.57721566490153286 + sum(1 / i for i in range(1, n)))) < 1e-12


def test_values_looked_up_elsewhere_do_not_grow_with_the_rows(spark, monkeypatch):
    """Of a part, only values whose neighbours reach over its edge are told apart; all others are counted where they lie."""
    from brackwater.operators import information, ranks

    held, cut_lineage = [], ranks.cut_lineage

    def kept(df):
        out = cut_lineage(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(ranks, "cut_lineage", kept)
    monkeypatch.setattr(information, "cut_lineage", kept, raising=False)
    more = []
    for n in (1500, 6000):
        df = spark.range(n).select((F.col("id") % 2).alias("label"), F.rand(3).alias("a"), F.rand(4).alias("b"))
        held.clear()
        assert information.mutual_information(df, ["a", "b"], "label", parts=6).count() == 2
        more.append(sum(held[1:]))  # the first are the values themselves
    assert max(more) <= 7 * 2 * 2 * (1 + 3 * 2 * 3)


@pytest.mark.parametrize("parts", [None, 1, 40])
def test_mutual_information(spark, parts):
    from brackwater.operators import information

    rng = np.random.default_rng(7)
    n = 240
    y = rng.choice(["hot", "hot", "hot", "rare", "two"], n).tolist()
    y[0], y[1], y[2], y[3] = "alone", None, "pair", "pair"
    a = rng.normal(size=n) + np.array([{"hot": 0, "rare": 3}.get(v, -2) for v in y])
    columns = {"wide": a.tolist(), "ties": a.round(0).tolist(), "noise": rng.random(n).tolist(), "same": [2.5] * n, "holes": [None if i % 3 else float(v) for i, v in enumerate(a.round(1))], "empty": [None] * n}
    columns["holes"][6], columns["holes"][9] = float("nan"), float("inf")
    rows = [(y[i], *(columns[c][i] for c in columns)) for i in range(n)]
    df = spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    for k in (1, 3):
        got = {r.column: r.mi for r in information.mutual_information(df, list(columns), "label", k=k, parts=parts).collect()}
        clean = {c: [None if v is None or v != v else v for v in x] for c, x in columns.items()}
        want = {c: plain_information(x, y, k) for c, x in clean.items()}
        assert set(got) == {c for c, v in want.items() if v is not None} == set(columns) - {"empty"}
        for c in got:
            assert abs(got[c] - want[c]) < 1e-9, c
    assert got["wide"] > 0.2 and information.mutual_information(df.limit(0), ["wide"], "label").count() == 0


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 20))
    x = base @ rng.normal(size=(20, 200)) + 1e6
    x[:, 5] = 7.25
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"c{i}" for i in range(200)]
    rows = [tuple(None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.a, r.b): r.r for r in exploration.correlations(df, names).collect()}
    assert len(got) == 200 * 199 // 2
    for i, j in [(0, 1), (3, 199), (7, 8), (100, 42), *rng.integers(0, 200, (60, 2))]:
        a, b = sorted((int(i), int(j)))
        if a == b:
            continue
        use = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        if 5 in (a, b):
            assert got[names[a], names[b]] is None
        else:
            assert abs(got[names[a], names[b]] - np.corrcoef(x[use, a], x[use, b])[0, 1]) < 1e-9
    assert all(r.r is None for r in exploration.correlations(df.limit(0), names[:3]).collect())


def test_clip_does_not_shuffle_rows_by_label(spark):
    df = spark.range(2000).selectExpr("id", "CAST(id % 2 AS INT) AS label", "CAST(id AS DOUBLE) AS v")
    out = exploration.clip_by_label(df, "v", "label")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(label" not in plan
    assert out.count() == exploration.clip_by_label(df, "v", "label", most_broadcast=0).count() == 1980
