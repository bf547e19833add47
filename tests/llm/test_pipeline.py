"""The pipeline against a brute-force version, stage by stage."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brackwater.llm import language, quality
from brackwater.session import table
from tests.llm.test_similar import shingles

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, DIR, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, DIR).cache()
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_schemas(stages):
    for df in stages[1:5]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "substring_dedup", "packing"]


def test_filters_follow_their_operators(spark, stages):
    model = quality.fit_trees(stages[0], table(spark, DIR, "labels"))
    assert set(rows(stages[1])) == {r.doc_id for r in quality.judge(stages[0], model).filter("kept").collect()}
    got = language.identify(stages[1], language.fit_dictionaries(stages[1])).collect()
    assert set(rows(stages[2])) == {r.doc_id for r in got if not r.rejected}


def test_near_copies_and_passages(stages):
    before, after, cut = rows(stages[2]), rows(stages[3]), rows(stages[4])
    sets = {k: shingles(r.text) for k, r in before.items()}
    root = {k: k for k in before}
    for _ in range(20):
        for a in sorted(before):
            for b in before:
                if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[r] == r for r in root.values()):
            break
    assert set(after) == set(root.values())
    first = {}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", r.text) for k, r in after.items()}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][i : i + 13]), k)
    for k, w in words.items():
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(13)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert cut[k].text == text and cut[k].n_chars == len(text) and cut[k].lang == before[k].lang


def test_packed_tokens(spark, stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in sorted(stages[5].collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.length & (r.length - 1) == 0
        got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == {k: library.encode(r.text, add_special_tokens=False).ids + [2] for k, r in rows(stages[4]).items()}
    assert corpus_pipeline.run(spark, DIR).count() == stages[5].count()


def test_clashing_columns_nulls_and_empty_tables(spark, stages):
    names = ("chunk", "n_words", "factors", "row_id", "carried", "block", "features", "rep", "ids", "score")
    docs = stages[0].limit(60).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    odd = docs.limit(1).select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs.limit(0), DIR).count() == 0, name
        out = f(spark, docs, DIR)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert r.doc_id is None or [r[n] for n in names] == list(range(len(names))), name
    assert corpus_pipeline.pack(spark, docs, DIR).count() > 60 and corpus_pipeline.pack(spark, docs.limit(0), DIR).count() == 0
