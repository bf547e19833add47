"""Packing (operator 6): power-of-two decomposition of token lists.

Each document's ids are cut into pieces whose lengths are powers of two: as many of the largest length as fit, then the
binary digits of the rest, the longest first. Pieces of one length form a bucket; every sequence is one piece, so no
sequence crosses documents, no attention mask is needed and nothing is padded. The work is map-side: no shuffle.

Defined cases: a null or empty text is the end id alone (one piece of length 1); a null key stays null; repeated rows
are packed as often as they come; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.tokens import SLICE, TOKENIZER_DIR, WordIds, _key_type
from brackwater.llm.words import bounded_batches, slices


def binary_pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of `sizes`: the list's number, the start and the length of each power-of-two piece, in order."""
    full = sizes // longest
    bits = longest.bit_length() - 1
    count = full + sum(((sizes >> b) & 1) for b in range(bits))
    doc = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(np.cumsum(count) - count, count)
    nth = np.arange(len(doc)) - first
    length = np.full(len(doc), longest, np.int64)
    rest = nth >= full[doc]
    digits = np.array([[b for b in range(bits)][::-1]], np.int64)
    for lo in range(0, len(sizes), 4096):  # the digits of the remainders, most significant first
        part = sizes[lo : lo + 4096, None] % longest
        has = ((part >> digits) & 1).astype(bool)
        values = np.broadcast_to(1 << digits, has.shape)[has]
        begin, end = np.searchsorted(doc, [lo, lo + len(part)])
        where = np.flatnonzero(rest[begin:end]) + begin
        length[where] = values
    start = np.cumsum(length) - length
    base = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=base[1:])
    return doc, start - base[doc], length


def pack(docs: DataFrame, model: str = "word_bpe_49k.json", *, key: str = "doc_id", text: str = "text", longest: int = 4096, end_id: int = 2, folder: str | None = TOKENIZER_DIR) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian uint32 bytes), doc_tokens, bucket (log2 of length), sequence_id, offset.

    `longest` must be a power of two. Sequence ids are unique and fixed by the input's partitions.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind, arrow = _key_type(docs, key)
    schema = pa.schema([(key, arrow), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(model, folder)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, ptr = words.lists(part.column(text))
                ids, ptr = np.insert(ids, ptr[1:], end_id), ptr + np.arange(len(ptr))
                sizes = np.diff(ptr)
                doc, start, length = binary_pieces(sizes, longest)
                raw = ids.astype("<u4").tobytes()
                bounds = np.zeros(len(length) + 1, np.int32)
                np.cumsum(length * 4, out=bounds[1:])
                blobs = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(doc)), pa.array(start), pa.array(length), blobs, pa.array(sizes[doc])], schema=schema)

    pieces = bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
