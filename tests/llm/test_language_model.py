"""LM scoring: counts by brute force, a probability that adds up to one, gradients, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brackwater.llm import language, language_model, queries
from brackwater.session import table

DIR = "/root/testdata/sf0.001"


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def check(rows, got):
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    c = Counter(x for k, t in rows if not held[k] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((k is None, k or 0, held[k], len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 6)) for k, t in rows)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_counts_and_gain(spark):
    docs = table(spark, DIR, "documents")
    got = queries.op3_lm_scores(spark, DIR).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    aside = [r for r in got if r.held_out]
    assert sum(r.score for r in aside) > sum(r.base_score for r in aside)
    assert all(r.score < 0 for r in got)


def test_small_cases(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "A a B", "b  é\nÉ", "b b b", "new words"] * 3)] + [(None, "a b"), (2, "A a B")]
    docs = spark.createDataFrame([(k, t, "x", True) for k, t in rows], "doc_id long, text string, chunk string, held_out boolean")
    fold = language.fold_of("doc_id", 5) == 1
    check(rows, language_model.score(docs, fold, start_epochs=1).collect())
    assert language_model.score(docs.limit(0), fold).count() == 0


def network(hidden=5, words=12):
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 2**63, words, dtype=np.uint64))
    rest = rng.integers(0, 50, language_model.SPELLINGS)
    counts = language_model.Counts(1000, 200, 20, h, rng.integers(5, 90, words), rest, (rest + 4) // 5)
    net = language_model.Network(counts, hidden, per_class=4)
    for k, v in net.p.items():
        if k != "word_b":
            v += rng.normal(0, 0.3, v.shape).astype(np.float32)
    return net


def test_what_is_learnt_from_grows_with_the_corpus(spark):
    docs = table(spark, DIR, "documents").select("doc_id", "text")
    sizes = []
    for n in (1, 2, 4):
        more = docs.crossJoin(spark.range(n)).select((F.col("doc_id") * 10 + F.col("id")).alias("doc_id"), "text")
        total = more.agg(F.sum(F.octet_length("text"))).first()[0]
        net = language_model.Network(network(4, 40).counts, 4)
        sizes.append(language_model.learn(more, net, total, key="doc_id", text="text", start_bytes=20_000, start_epochs=1, train_share=0.5, rounds=2))
    assert 1.6 < sizes[1][1] / sizes[0][1] < 2.5 and 1.6 < sizes[2][1] / sizes[1][1] < 2.4
    assert max(s for s, _ in sizes) < 60_000


def test_hot_key_is_not_drawn_as_one(spark):
    docs = table(spark, DIR, "documents").select(F.lit(None).cast("long").alias("doc_id"), "text")
    n = docs.distinct().filter(language_model._drawn("doc_id", "text", 43) < 0.25).count() / docs.distinct().count()
    assert 0.15 < n < 0.35


def test_averaging_weights(spark):
    nets = [network() for _ in range(3)]
    for i, n in enumerate(nets):
        n.p = {k: v + i for k, v in n.p.items()}
    want = {k: (1 * nets[0].p[k] + 2 * nets[1].p[k] + 5 * nets[2].p[k]) / 8 for k in nets[0].p}
    rows = pa.Table.from_batches([language_model._sliced(n, t) for n, t in zip(nets, (1, 2, 5), strict=True)])
    got = network()
    assert language_model._averaged(got, spark.createDataFrame(rows.to_pandas(), language_model._WEIGHTS)) == 8
    assert all(np.allclose(got.p[k], want[k], atol=1e-5) for k in want)
    assert language_model._averaged(got, spark.createDataFrame([], language_model._WEIGHTS)) == 0


def test_learning_lowers_the_loss():
    net = network(8, 12)
    rng = np.random.default_rng(3)
    texts = [np.append(np.tile([1, 2, 3, 4], rng.integers(1, 9)), net.end) for _ in range(200)]
    ptr = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    before = net.score(np.concatenate(texts), ptr).mean()
    assert net.train(texts, epochs=12, streams=8) == 12 * ptr[-1]
    assert net.score(np.concatenate(texts), ptr).mean() > before / 3


def test_probabilities_add_up():
    net = network()
    h = np.random.default_rng(2).normal(0, 1, (1, 5)).astype(np.float32)
    c = net.counts
    ids = np.arange(net.end + 1)
    p = np.exp(net.log_p(np.repeat(h, len(ids), 0), ids).astype(float))
    assert abs(p.sum() - 1) < 1e-5
    # inside a spelling class: (c + 0.5) / (N + 0.5 (V + 1)) over its words, and 0.5 for the unseen
    j = int(np.argmax(c.rest_distinct))
    n, v = c.rest_tokens[j], c.rest_distinct[j]
    assert abs((n + 0.5 * v + 0.5) / (n + 0.5 * (v + 1)) - 1) < 1e-12


def test_gradients():
    net = network()
    rng = np.random.default_rng(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, net.end + 1, (6, 3))
    before = np.vstack([np.full((1, 3), net.begin), ids[:-1]])
    start = rng.normal(0, 1, (3, 5))

    def loss():
        h, hs = start, []
        for t in range(6):
            h = np.where((before[t] == net.begin)[:, None], 0, h)
            h = net.step(net.p["x"][before[t]], h)[0]
            hs.append(h)
        return -net.log_p(np.concatenate(hs), ids.ravel()).mean()

    grads, _ = net._window(before, ids, start)
    for name, g in grads.items():
        for at in rng.choice(g.size, 12, replace=False):
            at = np.unravel_index(at, g.shape)
            if name == "word_b" and not net.real[at]:
                continue
            was = net.p[name][at]
            net.p[name][at] = was + 1e-5
            up = loss()
            net.p[name][at] = was - 1e-5
            down = loss()
            net.p[name][at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5, name


def test_state_is_carried_across_windows():
    net = network()
    rng = np.random.default_rng(6)
    sizes = np.array([40, 1, 7, 23])
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, net.end + 1, ptr[-1])
    whole = net.score(ids, ptr, window=1000)
    assert np.allclose(whole, net.score(ids, ptr, window=5), atol=1e-5)
    for a, b in zip(ptr, ptr[1:], strict=False):
        assert np.allclose(whole[a:b], net.score(ids[a:b], np.array([0, b - a])), atol=1e-4)


def test_outputs_are_worked_out_once(monkeypatch):
    net = network()
    ids = np.random.default_rng(7).integers(0, net.end + 1, (6, 3))
    before = np.vstack([np.full((1, 3), net.begin), ids[:-1]])
    told, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **more: told.append(np.size(x)) or exp(x, **more))
    net._window(before, ids, np.zeros((3, 5), np.float32))
    words = int((net.class_of[ids] < net.n_classes).sum())
    assert sum(told) == ids.size * (2 * net.hidden + len(net.p["class_b"])) + words * net.per_class
    asked, log_p = [], language_model.Network.log_p
    monkeypatch.setattr(language_model.Network, "log_p", lambda self, hs, ids: asked.append(len(ids)) or log_p(self, hs, ids))
    net.score(np.zeros(5000, np.int64), np.array([0, 4990, 5000]))  # a long text asks for its outputs at once, not every 64 words
    assert asked == [5000]


def test_outputs_of_any_size():
    rng = np.random.default_rng(8)
    hs, at = rng.uniform(-1, 1, (50, 5)).astype(np.float32), rng.integers(0, 9, 50)
    for scale in (0.1, 3, 300):  # the bound by weights holds, is loose, would lose whole rows
        w, b = (rng.normal(0, scale, s).astype(np.float32) for s in ((5, 9), 9))
        a = hs.astype(float) @ w + b
        top = a.max(1)
        whole = a - (top + np.log(np.exp(a - top[:, None]).sum(1)))[:, None]
        got = language_model._log_share(hs, w, b, at)
        assert np.allclose(got, whole[np.arange(50), at], rtol=1e-4, atol=1e-3)
        want = np.exp(whole)
        want[np.arange(50), at] -= 1
        assert np.allclose(language_model._misses(hs, w, b, at, np.float32(0.5)), want / 2, atol=1e-4)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = language.fold_of("doc_id", 5) == 1
    found = []
    for parts in (1, 8, 32):
        rows = language_model.score(docs.repartition(parts), held, start_bytes=50_000, start_epochs=1, vocabulary=256).collect()
        found.append({r.doc_id: r.score for r in rows})
    for other in found[1:]:
        assert found[0].keys() == other.keys()
        assert max(abs(other[k] / v - 1) for k, v in found[0].items()) < 1e-4


def test_network_learns_from_all_training_texts(spark, monkeypatch):
    told, learn = [], language_model.learn
    monkeypatch.setattr(language_model, "learn", lambda *a, **k: told.append(learn(*a, **k)) or told[-1])
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i} more text of {i}") for i in range(200)], "doc_id long, text string")
    rows = language_model.score(docs, F.col("doc_id") % 5 == 1).collect()
    assert told[0][1] == rows[0].train_tokens == sum(r.n_tokens for r in rows if not r.held_out)
