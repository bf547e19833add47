"""Chunks of documents, and packed 64-bit numbers that travel between them and the blocks of a hashed index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.words import bounded_batches


def text_size(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def in_chunks(docs: DataFrame, total: int, *columns: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = 4_000_000) -> DataFrame:
    """key, text and `columns` with a chunk number, so that a chunk has about `chunk_bytes` of text.

    The number is a hash of key and text: no source, bucket or key makes one chunk large, and a row read again after an
    executor is lost has the same number.
    """
    n = max(1, -(-total // chunk_bytes))
    return bounded_batches(docs).select(key, text, *columns, F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int").alias("chunk"))


def index_blocks(total: int, block_bytes: int = 16_000_000) -> int:
    return max(1, -(-total // block_bytes))


_FEW = 8


def squeeze(a: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit numbers by byte planes, compressed; ascending ones as differences. A few numbers stay as they are: they would
    not pay for the head of a compressed block, and where the collection is large most messages are short."""
    import zstandard

    if not len(a):
        return b""
    a = a.astype(np.uint64)
    if ascending:
        a = np.diff(a, prepend=np.uint64(0))
    if len(a) <= _FEW:
        return b"\0" + a.tobytes()
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(b: bytes, ascending: bool = False) -> np.ndarray:
    import zstandard

    if not b:
        return np.zeros(0, np.uint64)
    if b[0]:
        a = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    else:
        a = np.frombuffer(b, np.uint64, offset=1)
    return np.cumsum(a, dtype=np.uint64) if ascending else a


def block_bounds(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block's part of ascending hashes begins; a block is a range of hashes."""
    edges = np.array([(i << 64) // blocks for i in range(1, blocks)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]]).astype(np.int64)
