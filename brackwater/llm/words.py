"""Vectorised helpers on the UTF-8 bytes of a batch of texts: words, their hashes, and ragged gathers.

All of them run inside Spark tasks on slices of a bounded number of bytes (see `slices`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(n, U64(b))
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    if texts.buffers()[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def bounded_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, in a session that hands at most `rows` rows at once to Python: texts are long, and both sides of the pipe hold
    whole batches outside the heap. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(name)) <= rows:
        docs.sparkSession.conf.set(name, rows)
    return docs


def best_of(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of df in an order, put together by a task: an ordered limit that is collected as it stands sends n
    rows of every partition to the driver."""
    return df.orderBy(*order).limit(n).repartition(1)


def slices(table: pa.Table | pa.RecordBatch, column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text; a longer text is a slice of its own. No row is left out."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        if not len(batch):
            continue
        _, offs = text_bytes(batch.column(column))
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(offs, offs[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Spans:
    """Stretches of bytes of a batch of texts. `ptr[i]:ptr[i+1]` are the spans of text i."""

    buf: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def strings(self, which: np.ndarray) -> list[bytes]:
        whole = self.buf.tobytes()
        return [whole[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each span's bytes; of A-Z as of a-z if `lower`."""
        return hash_spans(self.buf, self.start, self.end, lower)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, block: int = 1_000_000) -> np.ndarray:
    """64-bit hash of buf[start:end] for ascending spans that do not overlap, in blocks of bounded size."""
    out = np.zeros(len(start), U64)
    table = _TABLE[LOWER] if lower else _TABLE
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > block:  # one long span: its blocks' sums, each moved to its place
            up, _ = _power(block)
            total = sum(int((table[buf[p : p + block]] * up[: min(block, hi - p)]).sum(dtype=U64)) * pow(_BASE, p - lo, 2**64) for p in range(lo, hi, block))
            out[i] = U64(total % 2**64)
        else:
            up, down = _power(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
            out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    return mix(out + (end - start).astype(U64))


def find_words(buf: np.ndarray, offs: np.ndarray) -> Spans:
    """Maximal runs of bytes other than space and 0x09-0x0D, within each text."""
    if not len(buf):
        return Spans(buf, offs, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Spans(buf, offs, start, end, np.searchsorted(start, offs))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours in h (across texts too; see `whole`)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(_BASE)
        out += h[j : j + n]
    return mix(out)


def whole(spans: Spans, k: int) -> np.ndarray:
    """Marks the positions whose k words all lie in one text."""
    n = max(0, len(spans.start) - k + 1)
    ok = np.ones(n, bool)
    for p in spans.ptr[1:-1]:
        ok[max(0, p - k + 1) : p] = False
    return ok


def gather(ptr: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `which` of a ragged array, one after another, and their pointers."""
    size = ptr[which + 1] - ptr[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(ptr[which] - out[:-1], size)
    return values[at], out


def ragged(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of values[ptr[i]:ptr[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values, kind))
