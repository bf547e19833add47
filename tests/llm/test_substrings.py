"""Substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.llm import exchange, substrings, words
from brackwater.session import table

DIR = "/root/testdata/sf0.001"


def brute(rows, span=13):
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    least = {}
    for k, w in split:
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            least[g] = min(least.get(g, float("inf")), float("inf") if k is None else k)
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - span + 1):
            if least[tuple(w[i : i + span])] < (float("inf") if k is None else k):
                gone |= set(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k is None, k or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("chunk", [3_000_000, 20_000])
def test_documents(spark, monkeypatch, chunk):
    inner = exchange.in_chunks
    monkeypatch.setattr(substrings, "in_chunks", lambda *a, **k: inner(*a, **k, chunk_bytes=chunk))
    monkeypatch.setattr(substrings, "index_blocks", lambda total: 1 if chunk > 100_000 else 5)
    docs = table(spark, DIR, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = substrings.remove_repeats(docs)
    assert got(df) == brute(rows)
    check_factors(rows, df)


def test_small_cases(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["a", "b", "é", "dd", "ünï"]
    base = [" ".join(rng.choice(vocabulary, 40)) for _ in range(4)]
    rows = [(i, " \n".join([base[i % 4], *rng.choice(vocabulary, 9), base[(i * 7) % 3]])) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \t"), (43, "a b"), (None, base[0]), (50, base[1]), (50, base[1]), (51, base[1] + "\n"), (52, "  " + base[1])]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, chunk string, n_words int")
    df = substrings.remove_repeats(docs, span=5)
    assert got(df) == brute(rows, 5)
    check_factors(rows, df)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        substrings.remove_repeats(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


def check_factors(rows, df):
    """Every factor is, word for word, a stretch of a document with a smaller key; factors do not overlap."""
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in df.collect():
        at = 0
        for f in r.factors:
            assert f.words > 0 and f.start >= at and f.source < (float("inf") if r.doc_id is None else r.doc_id)
            at = f.start + f.words
            stretches = {tuple(w[f.start : at]) for w in texts[r.doc_id]}
            assert stretches & {tuple(w[f.source_start : f.source_start + f.words]) for w in texts[f.source]}
        assert r.n_removed == sum(f.words for f in r.factors)


def test_factors_follow_the_reference(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", *a[10:40], *b[5:30], *a[40:60], "y", *a[50:55]])), (4, " ".join([*a[50:60], *a[:5]] + a[20:33])), (5, " ".join(a[:30] + ["z"] + a[30:]))]
    df = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    check_factors(rows, df)
    found = {r.doc_id: [tuple(f) for f in r.factors] for r in df.collect()}
    assert found == {1: [], 2: [], 3: [(1, 30, 1, 10), (31, 25, 2, 5), (56, 20, 1, 40)], 4: [(15, 13, 1, 20)], 5: [(0, 30, 1, 0), (31, 30, 1, 30)]}


def test_very_long_text_and_many_copies(spark):
    rng = np.random.default_rng(9)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 60_000))
    part = " ".join(long.split()[40_000:40_100])
    rows = [(1, long), (2, "q " * 30 + part), (3, long + " end")] + [(10 + i, part) for i in range(300)]
    df = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got_ = {r.doc_id: (r.n_words, r.n_removed) for r in df.collect()}
    # of the thirty q the phrases repeat within their own document only
    assert got_ == {1: (60_000, 0), 2: (130, 100), 3: (60_001, 60_000)} | {10 + i: (100, 100) for i in range(300)}


def test_messages_grow_in_proportion(spark):
    """Bytes between chunks and blocks for twice the text, with as many chunks and blocks as it asks for, are about twice."""
    rng = np.random.default_rng(5)
    sizes = []
    for n in (400, 800):
        hashes = np.sort(rng.integers(0, 2**63, n * 50, dtype=np.uint64))
        chunks, blocks = n // 20, n // 20
        parts = [hashes[i::chunks] for i in range(chunks)]
        sizes.append(sum(len(exchange.squeeze(p[c:d], True)) + 64 for p in parts for c, d in zip(*(lambda e: (e, e[1:]))(exchange.block_bounds(p, blocks)), strict=False) if d > c))
    assert sizes[1] < 2.6 * sizes[0]


def test_long_spans_hash_alike():
    buf = np.frombuffer(b"x" * 50 + b"abc" * 900, np.uint8)
    start, end = np.array([0, 50]), np.array([50, 2750])
    a = words.hash_spans(buf, start, end)
    b = words.hash_spans(buf, start, end, block=64)
    assert (a == b).all() and words.hash_spans(buf, start[1:], end[1:], block=100)[0] == a[1]


def test_numbers_travel():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (exchange.expand(exchange.squeeze(a, True), True) == a).all() and (exchange.expand(exchange.squeeze(a[::-1])) == a[::-1]).all()
    assert len(exchange.expand(exchange.squeeze(a[:0]))) == 0
    for n in (1, 8, 9):
        assert (exchange.expand(exchange.squeeze(a[:n], True), True) == a[:n]).all() and (exchange.expand(exchange.squeeze(a[:n][::-1])) == a[:n][::-1]).all()
    cut = exchange.block_bounds(a, 7)
    assert cut[0] == 0 and cut[-1] == 1000 and (np.diff(cut) >= 0).all()
