"""N-gram Jaccard join against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from brackwater.llm import similar
from brackwater.session import table

DIR = "/root/testdata/sf0.001"


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    big = float("inf")
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], big), big if k is None else k)
    return Counter((k, None if least[root[i]] == big else least[root[i]], len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})) for i, (k, _) in enumerate(rows))


def got(df):
    return Counter((r.doc_id, r.class_id, r.n_links, r.n_set_links) for r in df.collect())


def test_bands_reach_the_recall():
    bands, rows = similar.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_rows_follow_threshold_and_hashes():
    assert similar.bands_for() == (18, 5)
    for threshold in (0.3, 0.5, 0.7, 0.9, 1.0):
        bands, rows = similar.bands_for(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128
    assert similar.bands_for(0.9)[1] > similar.bands_for(0.5)[1] and similar.bands_for(0.01)[1] == 1


def test_tiles_count_every_pair_once():
    rng = np.random.default_rng(5)
    members = [np.unique(rng.choice(40, 30)).astype(np.uint64) for _ in range(50)]
    bands, weight = rng.integers(0, 3, (50, 4)), rng.integers(1, 4, 50)
    for sides in (np.zeros(50, int), rng.integers(0, 2, 50)):
        whole = similar.block_links(members, 2, bands, sides, weight, 0.3)
        for tile in (1, 7, 50):
            cut = similar.tiled_links(members, 2, bands, sides, weight, 0.3, tile)
            assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True)) and whole[1].sum() > 50


def test_rows_with_equal_first_hashes(spark, monkeypatch):
    """Rows whose first hash is one and the same are told apart by the second."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(similar, "_row_id", lambda key, text: F.lit(1).cast("long"))
    docs = spark.createDataFrame([(i, " ".join(f"{'abcd'[i // 3]}{j}" for j in range(40)) + " end" * (i % 3)) for i in range(12)], "doc_id long, text string")
    joined = similar.jaccard_join(docs)
    assert got(joined) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert joined.select("root").distinct().count() == 4
    assert sorted(r.doc_id for r in similar.one_of_each(docs, joined).collect()) == [0, 3, 6, 9]


def test_documents(spark):
    docs = table(spark, DIR, "documents")
    assert got(similar.jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("block", "block_bytes"), [(128, 1 << 20), (7, 1 << 20), (128, 1500)])
def test_groups_of_near_copies(spark, block, block_bytes):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, k = [], 0
    for size in (60, 3, 2, 1):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(size):
            own = list(base)
            for at in rng.choice(120, rng.integers(0, 3), replace=False):
                own[at] = "x"
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(100, None), (101, ""), (102, "  "), (103, "one two"), (104, "one  two\n"), (105, "one three"), (None, "one two"), (106, rows[0][1]), (106, rows[0][1]), (107, "a"), (None, None)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, band string")
    joined = similar.jaccard_join(docs, block=block, block_bytes=block_bytes)
    assert got(joined) == brute(rows)
    kept = Counter(r.doc_id for r in similar.one_of_each(docs, joined).collect())
    classes = {r.class_id for r in joined.collect()}
    assert set(kept) == classes and all(n == 1 for n in kept.values())
    assert similar.jaccard_join(docs.limit(0)).count() == 0


def test_unlike_texts_under_one_key(spark):
    unlike = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcdefgh"]
    rows = [(None, t) for t in unlike[:3]] + [(None, unlike[0] + " more")] + [(5, t) for t in unlike[3:6]] + [(7, unlike[6]), (5, unlike[6]), (5, unlike[6]), (9, unlike[7])]
    rows += [(None, None), (None, ""), (None, " "), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joined = similar.jaccard_join(docs)
    assert got(joined) == brute(rows)
    kept = Counter((r.doc_id, r.text) for r in similar.one_of_each(docs, joined).collect())
    near = {(None, unlike[0]), (None, unlike[0] + " more")}
    assert len(near & set(kept)) == 1
    assert Counter({r: n for r, n in kept.items() if r not in near}) == Counter(set(rows) - near - {(7, unlike[6])})
    roots = {}
    for r in joined.join(docs.select(similar._row_id("doc_id", "text").alias("row_id"), "text").distinct(), "row_id").collect():
        roots.setdefault(r.root, set()).add(r.text)
    assert len(roots) == 12 and {unlike[0], unlike[0] + " more"} in roots.values()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in similar.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
