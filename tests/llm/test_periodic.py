"""Periodic runs by brute force, on made-up words and on the smallest tables."""

import hashlib
import random
import re
import zlib

import numpy as np

from brackwater.llm import periodic, queries

DIR = "/root/testdata/sf0.001"


def plain_runs(w, exponent=4, least=6):
    """Every period, every stretch; a stretch with a smaller period is left out."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            stretch = w[i : i + size]
            if size >= max(least, exponent * q) and not any(stretch[d:] == stretch[: size - d] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_refinement_by_brute_force():
    rng = random.Random(5)
    docs = []
    for _ in range(300):
        n, k = rng.choice([0, 1, 5, 6, 7, 30, 80, 150]), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.choice([3, 4, 5, 8])
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        docs.append(w)
    ptr = np.cumsum([0, *map(len, docs)])
    words = np.array([d * 10 + x for d, w in enumerate(docs) for x in w], np.int64)
    for exponent, least in ((4, 6), (2, 2), (3, 9)):
        owner, *runs = periodic.find_runs(words, ptr, exponent, least)
        got = list(zip(*(x.tolist() for x in runs), strict=True))
        want = [plain_runs(w, exponent, least) for w in docs]
        assert [[r for r, o in zip(got, owner, strict=True) if o == d] for d in range(len(docs))] == want
        assert sum(map(len, want)) > 50


def test_equal_hashes_are_told_apart(monkeypatch):
    spans = periodic.find_words(*periodic.text_bytes(periodic.pa.array(["a b a c", "a b"])))
    monkeypatch.setattr(periodic.Spans, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    ids = periodic.word_classes(spans).tolist()
    assert ids[0] == ids[2] and len(set(ids)) == 5


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_by_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6_000]
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, DIR).select(COLUMNS).collect()}
    assert len(got) == 200 and len(docs) > 120
    want = {r.doc_id: plain_row(*r) for r in docs}
    assert {k: got[k] for k in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_odd_texts(spark):
    texts = [None, "", " \t", "a", "a a a a a", "a a a a a a", "é é é é é é ü", "a b a b a b a b", "x\ny x\ny x\ny x\ny", "w " * 60_000, " ".join(f"{i % 700}" for i in range(9_000))]
    rows = [(i, t, "clash", "clash", 0) for i, t in enumerate(texts)] + [(5, texts[5], "clash", "clash", 1), (None, "q q q q q q q", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed_text string, n_words int")
    got = periodic.periodic_runs(df).collect()
    assert len(got) == len(rows) and [r for r in got if r.doc_id == 5][0] == [r for r in got if r.doc_id == 5][1]
    by = {r.doc_id: r for r in got}
    runs = {i: [tuple(x) for x in by[i].runs] for i in range(len(texts))}
    assert runs == {i: plain_runs(t.split()) if i < 9 else runs[i] for i, t in enumerate(x or "" for x in texts)}
    assert runs[9] == [(0, 60_000, 1)] and by[9].collapsed_text == "w"
    assert runs[10] == [(0, 9_000, 700)] and len(by[10].collapsed_text.split()) == 700
    assert by[0].n_words == 0 and by[0].collapsed_text == "" and by[None].collapsed_text == "q"
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    halved = {r.doc_id: r for r in periodic.periodic_runs(df.repartition(7)).collect()}
    assert halved == by
