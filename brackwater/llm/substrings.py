"""Substring dedup (operator 2): relative Lempel-Ziv parsing against the indexed blocks of the whole collection.

The collection is its own reference. An index block holds a range of phrase hashes (`span` consecutive words) and for each
phrase its first place in the collection: the least key, and the word at which the phrase begins there. Documents are parsed
greedily from their start against all blocks: a factor opens at the first phrase that a document with a smaller key has, at
that place of the reference, and is drawn out word by word for as long as the reference goes on alike; so a factor (start,
words, source, source_start) is a stretch of the source, word for word. Where the reference ends or parts from the document,
the phrases across that boundary are looked up as well, and the next factor opens there. The words of all factors, none
shorter than a phrase before it is trimmed to where the last one ended, are the duplicate spans.

Messages travel between chunks of documents (bounded bytes, chosen by hash) and blocks:

1. a chunk asks each block about its distinct phrases, by 48 bits of the hash; the block marks those that another chunk has;
2. for the marked ones, some tenths of all, the chunk sends 96 bits of hash, its least key and the place there;
3. the block answers with the place of an earlier document wherever there is one.

A passage that a third of all documents share costs its block one entry a chunk. Chunks and blocks have bounded bytes, so no
task grows with the collection; the number of messages is at most that of phrases, and short ones are sent bare (see
`exchange.squeeze`), so the traffic grows in proportion. Text is shuffled once, and all three steps read that exchange.

Defined cases: a null text has no words; a text shorter than a phrase keeps all; rows with the same key do not duplicate one
another (only a smaller key counts), so repeated rows have equal results, and a source place of such a key is one in any of
its rows; a null key is larger than all others, and the largest 64-bit number counts as null; keys that are no whole numbers
are an error; an empty table gives an empty table; columns not asked for are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, StructType

from brackwater.llm.exchange import block_bounds, expand, in_chunks, index_blocks, squeeze, text_size
from brackwater.llm.words import U64, Spans, find_words, mix, rolling, text_bytes, whole

_LAST = np.iinfo(np.int64).max
_SHORT, _CHECK = U64(16), U64(32)  # bits left out of the first question, and of the second hash


def phrases_of(table: pa.Table, text: str, span: int) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, their hashes, and number (of the first word) and hash of each phrase."""
    spans = find_words(*text_bytes(table.column(text)))
    at = np.flatnonzero(whole(spans, span))
    words = spans.hashes()
    return spans, words, at, rolling(words, span)[at]


def second_hashes(words: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """32 further bits of hash of the phrases at these words."""
    return rolling(mix(words ^ U64(0x5BD1)), span)[at] >> _CHECK


def keys_of(table: pa.Table, key: str) -> np.ndarray:
    return table.column(key).combine_chunks().cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def groups(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a, and where in that order each distinct value begins."""
    order = np.argsort(a)
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[order][1:] != a[order][:-1]
    return order, np.flatnonzero(fresh)


def firsts(hashes: np.ndarray, checks: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each distinct phrase, ascending: a row that has it, the least key, the least place under that key. And each row's
    phrase among them."""
    order, begin = groups(hashes)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    c = checks[order]
    if (c != c[begin][group]).any():  # two phrases with one first hash
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        begin, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    which = np.empty(len(order), np.int64)
    which[order] = group
    if not len(begin):
        return order, keys, places, which
    k = keys[order]
    least = np.minimum.reduceat(k, begin)
    place = np.minimum.reduceat(np.where(k == least[group], places[order], _LAST), begin)
    return order[begin], least, place, which


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Greedy factors over the ascending word numbers `at` of phrases that have a source and a place there: first word, number
    of words, source, place of the first word there, document.

    A factor ends where the next phrase is not the next word, or has not the next place of the same source; it takes no word
    of the factor before.
    """
    if not len(at):
        return at, at, source, place, doc
    goes_on = (np.diff(at) == 1) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1) & (doc[1:] == doc[:-1])
    opens = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    last = np.append(opens[1:], len(at)) - 1
    begin, end = at[opens], at[last] + span
    before = np.concatenate([[0], end[:-1]])
    same = np.concatenate([[False], doc[opens][1:] == doc[opens][:-1]])
    trimmed = np.where(same, np.maximum(begin, before), begin)
    return trimmed, end - trimmed, source[opens], place[opens] + trimmed - begin, doc[opens]


def kept_texts(spans: Spans, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each text joined by one space, one text after another, and where each begins."""
    buf = spans.buf.copy()
    use = np.zeros(len(buf) + 1, np.int8)
    use[spans.start[keep]] = 1
    use[spans.end[keep]] -= 1  # words do not touch within a text; where two texts touch, the two marks add up to none
    mask = np.cumsum(use[:-1], dtype=np.int8).astype(bool)
    doc = spans.doc[keep]
    followed = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    gaps = spans.end[keep][followed]
    buf[gaps], mask[gaps] = 0x20, True
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(mask, out=at[1:])
    return buf[mask].tobytes(), at[spans.offs]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", span: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n_words, n_removed, kept_text, factors (start, words, source, source_start) and, if asked for, the struct
    `carried` of the columns `carry` (a struct, so that their names may be any)."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"keys must be whole numbers, {key} is {docs.schema[key].dataType.simpleString()}")
    total = text_size(docs, text)
    blocks = index_blocks(total)
    carried = [F.struct(*carry).alias("carried")] if carry else []
    docs = docs.select(key, text, *carried)
    chunks = in_chunks(docs, total, *(["carried"] if carry else []), key=key, text=text)
    chunk_type, blob = pa.int32(), pa.binary()

    def by_block(hashes: np.ndarray) -> list[tuple[int, slice]]:
        cut = block_bounds(hashes, blocks)
        return [(int(b), slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut))]

    def messages(chunk: int, found: list[tuple[int, slice]], **columns: tuple[np.ndarray, bool]) -> pa.Table:
        packed = {n: pa.array([squeeze(a[s], up) for _, s in found], blob) for n, (a, up) in columns.items()}
        return pa.table({"block": pa.array([b for b, _ in found], pa.int32()), "chunk": pa.array([chunk] * len(found), chunk_type), **packed})

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        short = np.sort(phrases_of(table, text, span)[3] >> _SHORT)
        short = short[np.append(True, short[1:] != short[:-1])] if len(short) else short
        return messages(group[0].as_py(), by_block(short << _SHORT), hashes=(short, True))

    def mark(group: tuple, table: pa.Table) -> pa.Table:
        parts = [expand(b.as_py(), True) for b in table.column("hashes")]
        _, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = (times > 1)[inverse.ravel()]
        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        out = [(c, np.packbits(shared[a:b]).tobytes()) for c, a, b in zip(table.column("chunk").to_pylist(), cut, cut[1:], strict=False) if shared[a:b].any()]
        return pa.table({"block": pa.array([group[0].as_py()] * len(out), pa.int32()), "chunk": pa.array([c for c, _ in out], chunk_type), "marks": pa.array([m for _, m in out], blob)})

    def send(group: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        spans, words, at, h = phrases_of(table, text, span)
        order, begin = groups(h >> _SHORT)
        cut = block_bounds((h[order[begin]] >> _SHORT) << _SHORT, blocks)
        wanted = np.zeros(len(begin), bool)
        for b, m in zip(marks.column("block").to_pylist(), marks.column("marks"), strict=True):
            n = int(cut[b + 1] - cut[b])
            wanted[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n).astype(bool)
        rows = order[np.repeat(wanted, np.diff(np.append(begin, len(order))))]
        at, h = at[rows], h[rows]
        doc = spans.doc[at]
        checks = second_hashes(words, at, span) if len(rows) else at.astype(U64)
        row, least, place, _ = firsts(h, checks, keys_of(table, key)[doc], at - spans.ptr[doc])
        return messages(group[0].as_py(), by_block(h[row]), hashes=(h[row], True), checks=(checks[row], False), sources=(least, False), places=(place, False))

    def answer(table: pa.Table) -> pa.Table:
        columns = [[expand(b.as_py(), up) for b in table.column(n)] for n, up in (("hashes", True), ("checks", False), ("sources", False), ("places", False))]
        h, c, own, at = (np.concatenate(x) for x in columns)
        own = own.view(np.int64)
        _, least, place, which = firsts(h, c, own, at.astype(np.int64))
        source, place = least[which], place[which]
        cut = np.concatenate([[0], np.cumsum([len(p) for p in columns[0]])])
        out = []
        for chunk, a, b in zip(table.column("chunk").to_pylist(), cut, cut[1:], strict=False):
            rows = np.flatnonzero(source[a:b] < own[a:b]) + a
            if len(rows):
                out.append((chunk, squeeze(h[rows], True), squeeze(c[rows]), squeeze(source[rows]), squeeze(place[rows])))
        names = ("chunk", "hashes", "checks", "sources", "places")
        return pa.table({n: pa.array([r[i] for r in out], blob if i else chunk_type) for i, n in enumerate(names)})

    def parse(group: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        spans, words, at, h = phrases_of(table, text, span)
        checks = second_hashes(words, at, span) if len(at) else at.astype(U64)
        doc = spans.doc
        own = keys_of(table, key)[doc[at]]
        given = [np.concatenate([np.zeros(0, U64), *(expand(b.as_py(), n == "hashes") for b in answers.column(n))]) for n in ("hashes", "checks", "sources", "places")]
        n = len(at)
        _, least, place, which = firsts(np.concatenate([h, given[0]]), np.concatenate([checks, given[1]]), np.concatenate([own, given[2].view(np.int64)]), np.concatenate([at - spans.ptr[doc[at]], given[3].astype(np.int64)]))
        hit = np.flatnonzero(least[which[:n]] < own)
        phrase = which[hit]
        begin, size, source, place, owner = factors(at[hit], least[phrase], place[phrase], doc[at[hit]], span)
        gone = np.zeros(len(doc) + 1, np.int64)
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + size, -1)
        keep = np.cumsum(gone[:-1]) == 0
        raw, cut = kept_texts(spans, keep)
        texts = pa.Array.from_buffers(pa.large_string(), len(table), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())
        values = pa.StructArray.from_arrays([pa.array(begin - spans.ptr[owner]), pa.array(size), pa.array(source), pa.array(place)], ["start", "words", "source", "source_start"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(table) + 1)), pa.int32()), values)
        removed = np.bincount(doc, ~keep, len(table)).astype(np.int64)
        return pa.table({key: table.column(key), "n_words": pa.array(np.diff(spans.ptr)), "n_removed": pa.array(removed), "kept_text": texts, "factors": lists, **({"carried": table.column("carried")} if carry else {})})

    asked = chunks.groupBy("chunk").applyInArrow(ask, "block int, chunk int, hashes binary")
    marks = asked.groupBy("block").applyInArrow(mark, "block int, chunk int, marks binary")
    sent = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(send, "block int, chunk int, hashes binary, checks binary, sources binary, places binary")
    answers = sent.groupBy("block").applyInArrow(answer, "chunk int, hashes binary, checks binary, sources binary, places binary")
    factor = StructType().add("start", "long").add("words", "long").add("source", "long").add("source_start", "long")
    schema = StructType([docs.schema[key]]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("factors", ArrayType(factor))
    schema = StructType([*schema.fields, docs.schema["carried"]]) if carry else schema
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(parse, schema)
