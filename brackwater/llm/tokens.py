"""Sub-word tokens of whole texts.

* `piece_encode`, `piece_decode` (operator 4): merge-type BPE of a sentencepiece model by a prefix table.
* `count_tokens` (operator 9): token counts by a map-side two-tier lookup.
* `word_ids` (used by packing): ids of a `tokenizers` JSON model.

A text is cut where no token can reach across (before a run of spaces and around line feeds for the piece model;
at white space and between ASCII letters, digits and signs for the word model), so that each distinct segment is
encoded once per worker. Worker caches hold at most `CACHE` segments in two generations; what was dropped is
encoded again, so the limit changes time, never results.

Defined cases: a null or empty text has no tokens besides the end id asked for; a literal U+2581 counts as a space, as
in the library; repeated rows give repeated results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.words import LOWER, SPACE, Spans, best_of, bounded_batches, find_words, gather, hash_spans, ragged, slices, text_bytes

CACHE = 200_000
#: Bytes of text encoded at once: larger than elsewhere, as each slice looks up its distinct segments.
SLICE = 2_000_000
#: Where the public vocabulary files lie, for workers; None asks the installed package.
TOKENIZER_DIR: str | None = None


def vocabulary_path(name: str, folder: str | None = TOKENIZER_DIR) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class SegmentCache:
    """hash of a segment -> its ids as little-endian int32 bytes; `encode` makes those of new segments."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], limit: int = CACHE):
        self.encode, self.limit, self.young, self.old = encode, limit, {}, {}

    def rows(self, hashes: np.ndarray, strings: Callable[[np.ndarray], list[bytes]]) -> list[bytes]:
        """The ids of segments with distinct `hashes`; strings(which) gives the bytes of those numbers."""
        young, old = self.young, self.old
        keys = hashes.tolist()
        found = [young.get(k) for k in keys]
        missing = []
        for i, (k, v) in enumerate(zip(keys, found, strict=True)):
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(i)
                else:
                    found[i] = young[k] = v
        if missing:
            for i, v in zip(missing, self.encode(strings(np.array(missing))), strict=True):
                found[i] = young[keys[i]] = v
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return found

    def lists(self, spans: Spans, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all spans one after another, and pointers by text."""
        if not len(hashes):
            return np.zeros(0, np.int32), np.zeros(len(spans.ptr), np.int64)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self.rows(keys, lambda which: spans.strings(first[which]))
        ptr = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // 4, out=ptr[1:])
        ids, at = gather(ptr, np.frombuffer(b"".join(rows), "<i4"), inverse.ravel())
        return ids, at[spans.ptr]


def piece_segments(texts: pa.Array) -> Spans:
    """Segments of the piece model's normal form (a space before each text that is not empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    if pc.any(pc.match_substring(texts, "▁")).as_py():
        texts = pc.replace_substring(texts, "▁", " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    buf, offs = text_bytes(texts)
    if not len(buf):
        return Spans(buf, offs, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    feed, space = buf == 0x0A, buf == 0x20
    begins = edge[:-1] | feed
    begins[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    start = np.flatnonzero(begins)
    return Spans(buf, offs, start, np.append(start[1:], len(buf)), np.searchsorted(start, offs))


class PieceTable:
    """Prefix table of a merge-type (BPE) sentencepiece model.

    For each prefix of a segment there is one token that can be its last: the matched piece t (found by an
    Aho-Corasick automaton over all pieces) for which the last token of the prefix before t may stand next to t.
    Two tokens may stand together if merging the characters of both by falling score gives just the two again;
    the outcome is remembered by pair. Reading the table backwards from the end gives the tokens.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, self.ids, self.rank, self.byte = model.eos_id(), {}, {}, [0] * 256
        self.surface: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                self.ids[piece], self.rank[piece] = i, -model.get_score(i)
                self.surface.append(piece.replace("▁", " ").encode())
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges neighbours by falling score, the leftmost first; for short texts."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        ok = left + right not in self.rank and self.merged(left + right) == [left, right]
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        self.pairs[pair] = ok
        return ok

    def tokens(self, segment: str) -> list[str]:
        """The tokens of a segment (with U+2581 for spaces); a character without a piece stands for itself."""
        if segment in self.rank and len(segment) < 2:
            return [segment]
        n, pairs, ids = len(segment), self.pairs, self.ids
        last: list[str | None] = [None] * (n + 1)
        for at, piece in self.automaton.iter(segment):
            at += 1
            if last[at] is None:
                begin = at - len(piece)
                if begin:
                    before = last[begin]
                    if before is None:  # the character before it has no piece of its own
                        before = self.alone(segment, begin, last)
                    pair = (before, piece)
                    ok = pairs.get(pair)
                    if not (self.fit(pair) if ok is None else ok):
                        continue
                last[at] = piece
        out, at = [], n
        while at:
            piece = last[at]
            if piece is None:
                piece = self.alone(segment, at, last)
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    @staticmethod
    def alone(segment: str, at: int, last: list[str | None]) -> str:
        last[at] = segment[at - 1]
        return last[at]

    def encode(self, segments: list[bytes]) -> list[bytes]:
        out = []
        ids, byte = self.ids, self.byte
        for s in segments:
            found = []
            for t in self.tokens(s.decode().replace(" ", "▁")):
                i = ids.get(t)
                if i is None:
                    found.extend(byte[b] for b in t.encode())
                else:
                    found.append(i)
            out.append(np.array(found, "<i4").tobytes())
        return out


def _with_lists(key: pa.Array, name: str, ids: np.ndarray, ptr: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, ragged(ids, ptr, pa.int32())], schema=schema)


def _key_type(docs: DataFrame, key: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    return kind.simpleString(), to_arrow_type(kind)


def piece_encode(docs: DataFrame, model: str = "piece_bpe_32k.model", *, key: str = "doc_id", text: str = "text", end: bool = True, folder: str | None = TOKENIZER_DIR) -> DataFrame:
    """key and `ids array<int>` of each whole text, as the sentencepiece library encodes it, with the end id if `end`."""
    kind, arrow = _key_type(docs, key)
    schema = pa.schema([(key, arrow), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(vocabulary_path(model, folder))
        cache = SegmentCache(table.encode)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                spans = piece_segments(part.column(text))
                ids, ptr = cache.lists(spans, spans.hashes())
                if end:
                    ids, ptr = np.insert(ids, ptr[1:], table.end), ptr + np.arange(len(ptr))
                yield _with_lists(part.column(key), "ids", ids, ptr, schema)

    return bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def piece_decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", *, key: str = "doc_id", ids: str = "ids", folder: str | None = TOKENIZER_DIR) -> DataFrame:
    """key, ids and the text that ids stand for. A null list decodes to ''. Bytes that are no UTF-8 become U+FFFD."""
    kind, arrow = _key_type(encoded, key)
    schema = pa.schema([(key, arrow), (ids, pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(vocabulary_path(model, folder))
        size = np.zeros(len(table.surface) + 1, np.int64)
        np.cumsum([len(x) for x in table.surface], out=size[1:])
        letters = np.frombuffer(b"".join(table.surface), np.uint8)
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                lists = part.column(ids)
                flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
                ptr = np.zeros(len(lists) + 1, np.int64)
                np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=ptr[1:])
                out, at = gather(size, letters, flat.astype(np.int64))
                raw, cut = out.tobytes(), at[ptr].tolist()
                texts = [raw[a + (raw[a : a + 1] == b" ") : b].decode(errors="replace") if a < b else "" for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(key), lists.cast(schema.field(ids).type), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>, text string")


def _library_counts(model: str, folder: str | None) -> Callable[[list[bytes]], list[int]]:
    """Number of tokens of each segment, from the sentencepiece library."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model, folder))

    def count(segments: list[bytes]) -> list[int]:
        # The library puts a space before what it gets; a segment without one is sent behind a line feed, whose two tokens go.
        sent = [s[1:].decode() if s[:1] == b" " else "\n" + s.decode() for s in segments]
        got = library.encode(sent, num_threads=1)
        return [max(1, len(g)) if s[:1] == b" " else len(g) - 2 for s, g in zip(segments, got, strict=True)]

    return count


LONGEST_FREQUENT = 64  # bytes of a segment in the table


def frequent_segments(docs: DataFrame, model: str, key: str, text: str, share: float, size: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest segments and their token counts; at most `size` of them, none above 64 bytes.

    They are counted in the rows that a hash of key and text draws, `share` of them, in every partition. A task keeps
    counts of at most eight times `size` segments and sends its `size` commonest; those are summed in Spark, and the driver
    gets the best. The table only saves work: a segment that is not in it is encoded by the task that meets it.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        strings: dict[int, bytes] = {}

        def best() -> list[tuple[int, int]]:
            return seen.most_common(size)

        for batch in batches:
            for part in slices(batch, text):
                spans = piece_segments(part.column(text))
                short = np.flatnonzero(spans.end - spans.start <= LONGEST_FREQUENT)
                keys, first, n = np.unique(spans.hashes()[short], return_index=True, return_counts=True)
                seen.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
                strings |= dict(zip(keys.tolist(), spans.strings(short[first]), strict=True))
                if len(seen) > 8 * size:
                    seen = Counter(dict(best()))
                    strings = {k: strings[k] for k in seen}
        found = best()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([strings[k] for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["segment", "n"])

    drawn = docs.filter(F.xxhash64(F.col(key), F.col(text), F.lit(61)) / F.lit(2.0**64) + 0.5 < share)
    counted = bounded_batches(drawn).select(text).mapInArrow(partial, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    segments = [bytes(r[0]) for r in best_of(counted, size, F.desc("n"), "segment").collect()]
    if not segments:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    raw = np.frombuffer(b"".join(segments), np.uint8)
    end = np.cumsum([len(s) for s in segments])
    hashes = hash_spans(raw, end - [len(s) for s in segments], end)
    order = np.argsort(hashes)
    return hashes[order], np.array(_library_counts(model, folder)(segments), np.int32)[order]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", *, key: str = "doc_id", text: str = "text", sample_share: float = 1 / 64, table_size: int = 32_768, folder: str | None = TOKENIZER_DIR) -> DataFrame:
    """key, n_bytes (UTF-8) and n_tokens of each whole text, without begin or end ids.

    Tier one is a broadcast table of at most `table_size` frequent segments (12 bytes each); tier two is each worker's
    cache, filled by the library. No segment of the counted texts is shuffled. Segments are told apart by 64 bits of hash: among
    10^10 different ones, a wrong length out of the table must be expected once in 50,000 runs.
    """
    kind, arrow = _key_type(docs, key)
    schema = pa.schema([(key, arrow), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(frequent_segments(docs, model, key, text, sample_share, table_size, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = shared.value
        count = _library_counts(model, folder)
        cache = SegmentCache(lambda segments: [n.to_bytes(4, "little") for n in count(segments)])
        for batch in batches:
            for part in slices(batch, text, SLICE):
                spans = piece_segments(part.column(text))
                h = spans.hashes()
                n = np.zeros(len(h), np.int64)
                hit = np.zeros(len(h), bool)
                if len(table):
                    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    hit = table[at] == h
                    n[hit] = lengths[at[hit]]
                rest = np.flatnonzero(~hit)
                if len(rest):
                    keys, first, inverse = np.unique(h[rest], return_index=True, return_inverse=True)
                    rows = cache.rows(keys, lambda which, s=spans, r=rest, f=first: s.strings(r[f[which]]))
                    n[rest] = np.frombuffer(b"".join(rows), "<i4")[inverse.ravel()]
                total = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=total[1:])
                size = pc.fill_null(pc.binary_length(part.column(text)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key), size, pa.array(np.diff(total[spans.ptr]))], schema=schema)

    return bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")


_KIND = np.full(256, 4, np.uint8)  # 4: signs and control characters
_KIND[SPACE] = 0
_KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[0x80:] = 3
_KIND[0x27] = 3  # an apostrophe can belong to either side


def word_segments(texts: pa.Array) -> Spans:
    """Segments that the word model encodes apart: words, cut further between ASCII letters, digits and signs."""
    buf, offs = text_bytes(texts)
    buf = LOWER[buf]
    words = find_words(buf, offs)
    if not len(buf):
        return words
    kind = _KIND[buf]
    if not ((buf == 0xCC) | (buf == 0xCD)).any():  # no combining marks: Latin-1 letters are letters like a to z
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)) + 1
        kind[second] = kind[second - 1] = 1
    begins = np.zeros(len(buf) + 1, bool)
    begins[words.start] = begins[words.end] = True
    left, right = kind[:-1], kind[1:]
    begins[1:-1] |= (left != 3) & (right != 3) & ((left != right) | (left == 2))
    bounds = np.flatnonzero(begins[:-1])
    inside = kind[bounds] != 0
    start, end = bounds[inside], np.append(bounds[1:], len(buf))[inside]
    return Spans(buf, offs, start, end, np.searchsorted(start, offs))


#: Printable ASCII without an apostrophe: such a segment is all letters, one digit or all signs.
_PLAIN = re.compile(rb"[!-&(-~]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class WordIds:
    """ids of whole texts by a `tokenizers` JSON model, without added special tokens."""

    def __init__(self, model: str = "word_bpe_49k.json", folder: str | None = TOKENIZER_DIR):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(model, folder))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = SegmentCache(self._encode, 500_000)

    def _encode(self, segments: list[bytes]) -> list[bytes]:
        """A segment that normalising leaves alone and the pre-tokenizer does not cut goes straight to the library's merges."""
        merge, out, rest = self.library.model.tokenize, [b""] * len(segments), []
        for i, s in enumerate(segments):
            if _PLAIN(s) or ((t := s.decode()).isalpha() and max(t) < "\u0180" and t == t.lower()):
                out[i] = b"".join([t.id.to_bytes(4, "little") for t in merge(s.decode("latin-1").translate(_BYTE_LETTERS))])
            else:
                rest.append(i)
        if rest:
            got = self.library.encode_batch_fast([segments[i].decode() for i in rest], add_special_tokens=False)
            for i, g in zip(rest, got, strict=True):
                out[i] = np.array(g.ids, "<i4").tobytes()
        return out

    def lists(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        spans = word_segments(texts)
        ids, ptr = self.cache.lists(spans, spans.hashes())
        odd = np.zeros(len(texts), bool)
        for s in self.special:  # the library takes these strings for one token wherever they stand
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if odd.any():
            rows = [ids[a:b] for a, b in zip(ptr, ptr[1:], strict=False)]
            for i in np.flatnonzero(odd):
                rows[i] = np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
            ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            ids = np.concatenate(rows)
        return ids, ptr
