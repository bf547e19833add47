"""Tokens and packing against the libraries themselves."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brackwater.llm import packing, queries, tokens
from brackwater.llm.words import hash_spans

ODD = [None, "", " ", "  a  b ", "a\n b\n\nc", "\n", "\nfoo\r\nbar", "é́x 　y", "</s> <s> <unk> <0x0A>", "a▁b", "x\x00y", "ﬁ \U0001f600\U0001f469‍\U0001f469", "a\tb", "日本語のテキスト", "It's 'twas don't 'Something 12a3b!!?? <|endoftext|> end", "É́ İstanbul ΑΣ ß-ß", "wordé.—.x“y”", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "z" * 30000 + " \r\r  ", "The Cat's  cat", "é,è.Ÿ!ß3ñ×÷ÀÉ-ö's naïve’s ﬁ ŉ K Å", "e\u0301,ab,\u0301 ç", "\x00a\x1cb\x7f\x85c\xa0d", "ÿ\u0300. ǆ ǅ"]
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, "  a  b ", "x")], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_piece_encode_is_the_librarys(spark, odd, library):
    for docs in (odd, spark.read.parquet(f"{DIR}/documents.parquet")):
        want = {r.doc_id: r.text or "" for r in docs.collect()}
        got = tokens.piece_decode(tokens.piece_encode(docs)).collect()
        assert len(got) == docs.count()
        for r in got:
            ids = library.encode(want[r.doc_id], add_eos=True)
            assert r.ids == ids, want[r.doc_id][:80]
            assert r.text == library.decode(ids)


def test_prefix_table_is_plain_merging():
    t = tokens.PieceTable(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    for _ in range(500):
        s = "▁" + "".join(rng.choice(list("aeinrstlouhé\r(;"), rng.integers(1, 14)))
        assert t.tokens(s) == t.merged(s), s


def test_counts_are_the_librarys(spark, odd, library):
    for docs in (odd, spark.read.parquet(f"{DIR}/documents.parquet")):
        want = {r.doc_id: r.text or "" for r in docs.collect()}
        for share, size in ((0.0, 50), (0.5, 20), (1.0, 5000)):
            for r in tokens.count_tokens(docs, sample_share=share, table_size=size).collect():
                assert (r.n_bytes, r.n_tokens) == (len(want[r.doc_id].encode()), len(library.encode(want[r.doc_id])))


def test_frequent_segments_come_from_all_partitions(spark, library):
    rows = [(i, "alpha " * 5 if i < 500 else "omega beta " * 5) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    h, n = tokens.frequent_segments(docs, "piece_bpe_32k.model", "doc_id", "text", 0.2, 3, None)
    words = [b" alpha", b" omega", b" beta"]
    end = np.cumsum([len(w) for w in words])
    want = hash_spans(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end)
    assert h.tolist() == sorted(want.tolist())
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == {k: len(library.encode(w[1:].decode())) for k, w in zip(want.tolist(), words, strict=True)}


def test_packing_pieces(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (odd.dropDuplicates(["doc_id"]), spark.read.parquet(f"{DIR}/documents.parquet")):
        want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
        got = {}
        rows = packing.pack(docs).collect()
        assert len({r.sequence_id for r in rows}) == len(rows)
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert len(ids) == r.length == 1 << r.bucket <= 4096 and r.offset == 0 and r.doc_tokens == len(want[r.doc_id])
            assert r.start == len(got.setdefault(r.doc_id, []))
            got[r.doc_id] += ids
        assert got == want


def test_packing_query_digest(spark):
    for r in queries.op6_packing(spark, DIR).limit(20).collect():
        assert 0 <= r.ids_crc32 < 2**32
    assert zlib.crc32(b"") == 0


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert tokens.count_tokens(none).count() == tokens.piece_encode(none).count() == packing.pack(none).count() == 0


def test_binary_pieces():
    sizes = np.array([1, 0, 4096, 4097, 12345, 7])
    doc, start, length = packing.binary_pieces(sizes, 4096)
    for d, n in enumerate(sizes):
        own = length[doc == d]
        assert own.sum() == n and (start[doc == d] == np.cumsum(own) - own).all() and (np.diff(own) <= 0).all()
