"""Suffix-array dedup by a table of all strings, on made-up bytes and on the smallest tables."""

import hashlib
import random

import numpy as np
import pytest

from brackwater.llm import queries, suffixes

DIR = "/root/testdata/sf0.001"


def plain(rows, span):
    """For (key, text): key, bytes, removed, spans, kept. Rows that share a key are one document."""
    first = {}
    last = 2**63 - 1
    data = [(last if k is None else k, k, (t or "").encode()) for k, t in rows]
    for k, _, t in data:
        for i in range(len(t) - span + 1):
            w = t[i : i + span]
            if (k, i) < first.get(w, (last, last)):
                first[w] = (k, i)
    out = []
    for k, own, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if first[t[i : i + span]] < (k, i):
                gone[i : i + span] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        spans = [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        out.append((own, len(t), int(gone.sum()), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def test_suffix_sort(monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3, (500, 12)).astype(np.uint8)
    sizes = rng.integers(0, 13, 500)
    want = sorted(range(500), key=lambda i: (bytes(rows[i, : sizes[i]]), i))
    order, shared = suffixes.Suffixes(rows, sizes).sort()
    assert order.tolist() == want
    pairs = [(bytes(rows[a, : sizes[a]]), bytes(rows[b, : sizes[b]])) for a, b in zip(want, want[1:], strict=False)]
    assert shared[1:].tolist() == [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in pairs]
    liar = suffixes.Suffixes(rows, sizes)
    liar.sums[:] = 0  # every hash collides: the order is put right by the bytes
    order, again = liar.sort()
    assert order.tolist() == want and (again == shared).all()


@pytest.mark.parametrize(("span", "gram", "most_group"), [(12, 6, 20_000), (12, 6, 2), (12, 12, 0), (20, 5, 50)])
def test_all_strings(spark, span, gram, most_group):
    rng = random.Random(span + most_group)
    letters = "ab"
    word = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    shared = [word(60, "abcdéf") for _ in range(4)]
    rows = [(i, "".join(rng.choice([rng.choice(shared), rng.choice(shared)[5:30], word(rng.randrange(30), "abcdefgh")]) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(100 + i, word(40)) for i in range(10)] + [(200, "ab" * 60), (201, "z" * 100), (202, shared[0] * 4)]
    rows += [rows[3], rows[3], (7, shared[1] + "x" + shared[2]), (None, shared[0]), (None, None), (300, ""), (301, "  "), (302, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, kept string")
    want = plain(rows, span)
    assert sum(r[2] for r in want) > 1000
    for chunk_bytes, block_bytes in ((400, 2_000), (10**6, 10**6)):
        assert got(suffixes.remove_repeats(df, span=span, gram=gram, most_group=most_group, chunk_bytes=chunk_bytes, block_bytes=block_bytes)) == want


def test_long_text_over_segments(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, long[5_000:9_000] + "#" + long[:700]), (3, long[:15_000] + "!" + long[15_000:]), (4, long + long)]
    want = plain(rows, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.remove_repeats(df)) == want
    buf = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offs = np.cumsum([0, *[len(t) for _, t in rows]])
    whole = suffixes.find_anchors(buf, offs, 100, 52)
    monkeypatch.setattr(suffixes, "_SEGMENT", 1000)
    parts = suffixes.find_anchors(buf, offs, 100, 52)
    strings = lambda e: sorted((int(s), int(p)) for p, a, b in zip(e.place, e.first, e.last, strict=True) for s in range(a, b + 1))
    assert strings(whole) == strings(parts) and len(whole.place) == len(parts.place)


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = [(k, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for k, n, gone, spans, kept in plain(rows, 100)]
    found = queries.op11_suffix_dedup(spark, DIR).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert sum(r[2] for r in want) > 10_000


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "x" * 200)], "doc_id long, text string")
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        suffixes.remove_repeats(df.withColumn("doc_id", df.doc_id.cast("string")))
