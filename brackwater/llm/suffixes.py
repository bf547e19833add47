"""Suffix-array dedup (operator 11): bytes covered by a string of `span` bytes that also starts earlier are removed.

A suffix array of the whole collection is sparse here: of each `span` bytes one place is an anchor, that of the least hash of
`gram` bytes in them (the first of equals). Equal strings have equal anchors at equal distances, so only suffixes that begin
at anchors of one hash need sorting, in both directions: strings of two occurrences are equal `o` bytes before the anchor if
the reversed suffixes share `o` bytes and the forward ones the rest. Suffixes are sorted by mergesort; two of them are
compared by a binary search over the prefix polynomial hashes for the length of their common extension, and then one byte.
Neighbours in the sorted order are compared byte by byte, and if a hash has lied, the block is sorted by its bytes.

Text is dealt into chunks of bounded bytes by hash (`exchange.in_chunks`) and shuffled once; anchors meet in blocks by ranges of
their hash:

1. a chunk asks about its distinct anchors (48 bits) and with how many surroundings it has them; the block marks those that
   another chunk has, and those with more surroundings than `most_group`;
2. for the marked ones the chunk sends each distinct surrounding once (64 bits of hash of the anchor, and 64 of all bytes that a
   string with this anchor can have; equal hashes count as equal bytes), with its first place; the block says whether it was there earlier, and whether it is one of several;
3. only of first ones among several the bytes travel, and the block sorts their suffixes;
4. the chunk removes the bytes of all strings found earlier.

An anchor with very many surroundings (the edge of a passage that a third of all documents share) is no single group: in step 2
each of its strings travels as two hashes (128 bits) to the block of the string's own hash, one entry a chunk. Chunks, blocks and
groups are bounded, so no task grows with the collection.

Defined cases: a null text has no bytes; repeated rows have equal results, and rows that share a key count as one document (a
string that starts there at a smaller byte is earlier); a null key is larger than all others; keys that are no whole numbers
are an error; an empty table gives an empty table; columns not asked for are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegralType, StructType

from brackwater.llm.exchange import block_bounds, expand, in_chunks, index_blocks, squeeze, text_size
from brackwater.llm.substrings import keys_of
from brackwater.llm.words import _TABLE, U64, _power, mix, text_bytes

_SECOND = np.random.default_rng(19930711).integers(1, 2**63, 257, dtype=np.uint64) * U64(2) + U64(1)
_SEGMENT = 1 << 20
_SHORT = U64(16)


def _sums(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


@dataclass
class Entries:
    """Anchors of a chunk: place, first and last string of which it is the anchor, text, hash, hash of the surroundings."""

    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    around: np.ndarray


def find_anchors(buf: np.ndarray, offs: np.ndarray, span: int, gram: int) -> Entries:
    """Anchors of all strings of `span` bytes within one text, worked out in segments of bounded size."""
    reach, wide = span - gram, span - gram + 1
    found = []
    for a in range(0, len(buf), _SEGMENT):
        b = min(len(buf), a + _SEGMENT)
        lo, hi = max(0, a - reach), min(len(buf), b + reach + span)
        if hi - a < span:
            break
        up, down = _power(hi - lo + 1)
        sums = _sums(_TABLE[buf[lo:hi]], up)
        least = (sums[gram:] - sums[:-gram]) * (down[: hi - lo - gram + 1] * U64(0xD6E8FEB86659FD93))
        least &= U64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=U64)  # the first of equal hashes is the least
        size = 1
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if wide > size:
            least = np.minimum(least[: size - wide], least[wide - size :])
        at = least[a - lo : b - lo].astype(np.uint32)
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        place = at[cut].astype(np.int64) + lo
        doc = np.searchsorted(offs, place, "right") - 1
        begin, end = offs[doc], offs[doc + 1]
        first = np.maximum(cut + a, begin)
        last = np.minimum(np.append(cut[1:], len(at)) - 1 + a, end - span)
        use = np.flatnonzero(first <= last)
        place, first, last, doc, begin, end = (x[use] for x in (place, first, last, doc, begin, end))
        x, y, p = np.maximum(place - reach, begin) - lo, np.minimum(place + span, end) - lo, place - lo
        sizes = ((p - x) * 65536 + y - p).astype(U64)
        found.append((place, first, last, doc, mix((sums[p + gram] - sums[p]) * down[p]), mix((sums[y] - sums[x]) * down[x] + mix(sizes))))
    if not found:
        none = np.zeros(0, np.int64)
        return Entries(none, none, none, none, none.astype(U64), none.astype(U64))
    place, first, last, doc, hashes, around = (np.concatenate(x) for x in zip(*found, strict=True))
    fresh = np.append(True, place[1:] != place[:-1])[: len(place)]
    begin = np.flatnonzero(fresh)  # an anchor whose strings begin in two segments is one
    last = last[np.append(begin[1:], len(place)) - 1] if len(begin) else last
    return Entries(place[begin], first[begin], last, doc[begin], hashes[begin], around[begin])


def string_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Starts of all strings from first[i] to last[i], the range each is of, and two hashes of each string."""
    starts, owner, one, two = [], [], [], []
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last - first[i], _SEGMENT)))  # places ascend
        lo, hi = int(first[i]), int(last[j - 1]) + span
        up, down = _power(hi - lo + 1)
        size = last[i:j] - first[i:j] + 1
        ends = np.cumsum(size)
        s = np.arange(ends[-1]) + np.repeat(first[i:j] - (ends - size), size)
        for table, out in ((_TABLE, one), (_SECOND, two)):
            sums = _sums(table[buf[lo:hi]], up)
            out.append(mix((sums[s + span - lo] - sums[s - lo]) * down[s - lo]))
        starts.append(s)
        owner.append(np.repeat(np.arange(i, j), size))
        i = j
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    return tuple(np.concatenate(x) for x in (starts, owner, one, two))


class Suffixes:
    """Strings of bounded length (rows of bytes, each up to its size) with the hashes of all their prefixes."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.chars = rows.astype(np.uint16) + np.uint16(1)
        self.chars[np.arange(rows.shape[1])[None, :] >= sizes[:, None]] = 0  # an end is less than all bytes
        up, _ = _power(rows.shape[1] + 1)
        self.sums = np.zeros((len(rows), rows.shape[1] + 1), U64)
        np.cumsum(_SECOND[self.chars] * up[None, : rows.shape[1]], axis=1, out=self.sums[:, 1:])
        head = np.zeros((len(rows), 4), U64)
        head[:, : min(4, rows.shape[1])] = self.chars[:, :4]
        self.head = (head << np.array([48, 32, 16, 0], U64)).sum(1, dtype=U64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a[i] and b[i], by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.chars.shape[1])
        for _ in range(int(self.chars.shape[1]).bit_length()):
            mid = (low + high + 1) // 2
            same = self.sums[a, mid] == self.sums[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as row a[i] is before, equal to or after b[i]."""
        x, y = self.head[a], self.head[b]
        out = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        open_ = np.flatnonzero(out == 0)
        a, b = a[open_], b[open_]
        at = self.common(a, b)
        inside = np.minimum(at, self.chars.shape[1] - 1)
        x, y = self.chars[a, inside], self.chars[b, inside]
        out[open_] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        return out

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows in order, and the length of the common prefix of each with the one before (0 for the first)."""
        n = len(self.sizes)
        order, width = np.arange(n), 1
        while width < n:  # all pairs of runs are merged at once: a row's place is its own plus what is before it in the other run
            at = np.arange(n)
            run = at // width
            left = run % 2 == 0
            begin = np.minimum((run ^ 1) * width, n)
            low, high = begin.copy(), np.minimum(begin + width, n)
            busy = np.flatnonzero(low < high)
            while len(busy):
                mid = (low[busy] + high[busy]) // 2
                sign = self.compare(order[mid], order[busy])
                goes_up = np.where(left[busy], sign < 0, sign <= 0)
                low[busy] = np.where(goes_up, mid + 1, low[busy])
                high[busy] = np.where(goes_up, high[busy], mid)
                busy = busy[low[busy] < high[busy]]
            to = (run // 2) * 2 * width + (at - run * width) + (low - begin)
            merged = np.empty(n, np.int64)
            merged[to] = order
            order, width = merged, width * 2
        shared, right = self.checked(order)
        if not right:
            raw = np.ascontiguousarray(self.chars.astype(">u2")).view(f"V{2 * self.chars.shape[1]}").ravel()
            order = np.argsort(raw, kind="stable")
            shared, _ = self.checked(order)
        return order, shared

    def checked(self, order: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common prefixes of neighbours by their bytes, and whether the order is right."""
        shared = np.zeros(len(order), np.int64)
        right = True
        for s in range(1, len(order), 1 << 14):
            a, b = order[s - 1 : s - 1 + (1 << 14)], order[s : s + (1 << 14)]
            a = a[: len(b)]
            differ = self.chars[a] != self.chars[b]
            at = np.where(differ.any(1), differ.argmax(1), self.chars.shape[1])
            inside = np.minimum(at, self.chars.shape[1] - 1)
            right = right and bool((self.chars[a, inside] <= self.chars[b, inside]).all())
            shared[s : s + len(b)] = np.minimum(at, np.minimum(self.sizes[a], self.sizes[b]))
        return shared, right


def found_earlier(rows: np.ndarray, before: np.ndarray, after: np.ndarray, keys: np.ndarray, places: np.ndarray, span: int, gram: int) -> np.ndarray:
    """For surroundings (bytes before and after an anchor, and their numbers) a mask of the distances at which a string
    begins that another of them has at an earlier place."""
    reach = span - gram
    n = len(rows)
    out = np.zeros(n, U64)
    sides = [Suffixes(rows[:, reach - 1 :: -1] if reach else rows[:, :0], before).sort() if reach else (np.arange(n), np.zeros(n, np.int64)), Suffixes(rows[:, reach:], after).sort()]
    classes = np.empty((2, n), np.int64)
    for o in range(reach + 1):
        use = np.flatnonzero((o <= before) & (span - o <= after))
        if len(use) < 2:
            continue
        for side, (order, shared) in enumerate(sides):
            classes[side, order] = np.cumsum(shared < (span - o if side else o)) if side or o else 0
        pair = classes[0, use] * (n + 1) + classes[1, use]
        order = np.lexsort((places[use], keys[use], pair))
        pair, k, p = pair[order], keys[use][order], places[use][order]
        first = np.searchsorted(pair, pair)
        late = (k > k[first]) | (p > p[first])
        out[use[order[late]]] |= U64(1) << U64(o)
    return out


@dataclass
class Sent:
    """What a chunk sends in step 2: distinct (hash, other hash), ascending, each with its first key and place; `item` is where that
    is in the list of all (anchors marked, then strings of crowded anchors), `group` the number of each of the list."""

    hashes: np.ndarray
    others: np.ndarray
    keys: np.ndarray
    places: np.ndarray
    item: np.ndarray
    group: np.ndarray
    late: np.ndarray
    anchors: np.ndarray
    starts: np.ndarray


class Chunk:
    """One chunk's text and anchors, and what becomes of them by the answers of the blocks."""

    def __init__(self, table: pa.Table, key: str, text: str, span: int, gram: int, blocks: int):
        self.span, self.gram, self.blocks = span, gram, blocks
        self.buf, self.offs = text_bytes(table.column(text))
        self.keys = keys_of(table, key)
        e = self.entries = find_anchors(self.buf, self.offs, span, gram)
        order = np.lexsort((e.around, e.hashes))
        h, c = e.hashes[order] >> _SHORT, e.around[order]
        fresh = np.append(True, h[1:] != h[:-1])[: len(h)]
        other = fresh.copy()
        other[1:] |= (c[1:] != c[:-1]) | (e.hashes[order][1:] != e.hashes[order][:-1])
        begin = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        self.short = h[begin]
        self.number = np.empty(len(h), np.int64)
        self.number[order] = number
        self.times = np.bincount(number, minlength=len(begin))
        self.kinds = np.bincount(number, other, len(begin)).astype(np.int64)

    def parts(self, hashes: np.ndarray) -> list[tuple[int, slice]]:
        cut = block_bounds(hashes, self.blocks)
        return [(int(b), slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut))]

    def aligned(self, answers: pa.Table, step: int, hashes: np.ndarray) -> np.ndarray:
        """The answers of a step, one number for each hash that was sent."""
        out = np.zeros(len(hashes), U64)
        cut = block_bounds(hashes, self.blocks)
        rows = answers.filter(pc.equal(answers.column("step"), step))
        for b, codes in zip(rows.column("block").to_pylist(), rows.column("codes"), strict=True):
            out[cut[b] : cut[b + 1]] = expand(codes.as_py())
        return out

    def sent(self, answers: pa.Table) -> Sent:
        e = self.entries
        marks = np.maximum(self.aligned(answers, 1, self.short << _SHORT), (self.times > 1).astype(U64))[self.number]
        anchors, crowded = np.flatnonzero(marks == 1), np.flatnonzero(marks == 2)
        crowded = crowded[np.argsort(e.first[crowded], kind="stable")]
        starts, _, one, two = string_hashes(self.buf, e.first[crowded], e.last[crowded], self.span)
        doc = np.concatenate([e.doc[anchors], np.searchsorted(self.offs, starts, "right") - 1])
        h, c = np.concatenate([e.hashes[anchors], one]), np.concatenate([e.around[anchors], two])
        keys, places = self.keys[doc], np.concatenate([e.place[anchors], starts]) - self.offs[doc]
        order = np.lexsort((places, keys, c, h))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
        item = order[fresh]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        late = (keys > keys[item][group]) | ((keys == keys[item][group]) & (places > places[item][group]))
        return Sent(h[item], c[item], keys[item], places[item], item, group, late, anchors, starts)

    def several(self, sent: Sent, codes: np.ndarray) -> np.ndarray:
        """Groups whose bytes the blocks must see: first ones among several, of anchors (not of strings)."""
        return np.flatnonzero((codes == 2) & (sent.item < len(sent.anchors)))

    def surroundings(self, sent: Sent, groups: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bytes around the anchors of these groups, and how many before and after are of the same text."""
        e, reach = self.entries, self.span - self.gram
        rows = sent.anchors[sent.item[groups]]
        place, begin, end = e.place[rows], self.offs[e.doc[rows]], self.offs[e.doc[rows] + 1]
        before, after = np.minimum(place - begin, reach), np.minimum(end - place, self.span)
        at = place[:, None] + np.arange(-reach, self.span)[None, :]
        inside = (at >= begin[:, None]) & (at < end[:, None])
        raw = np.where(inside, self.buf[np.clip(at, 0, max(0, len(self.buf) - 1))] if len(self.buf) else 0, 0).astype(np.uint8)
        return raw, before, after

    def gone(self, sent: Sent, codes: np.ndarray, groups: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Marks the bytes of all strings that start earlier elsewhere."""
        e, n = self.entries, len(sent.anchors)
        found = sent.late | (codes == 1)[sent.group]
        edge = np.zeros(len(self.buf) + 1, np.int64)

        def cover(first: np.ndarray, last: np.ndarray) -> None:
            np.add.at(edge, first, 1)
            np.add.at(edge, last + self.span, -1)

        whole = sent.anchors[found[:n]]
        cover(e.first[whole], e.last[whole])
        starts = sent.starts[found[n:]]
        cover(starts, starts)
        mask = np.zeros(len(sent.hashes), U64)
        mask[groups] = masks
        part = np.flatnonzero(~found[:n] & (mask[sent.group[:n]] > 0))
        rows, bits = sent.anchors[part], mask[sent.group[:n][part]]
        for o in range(self.span - self.gram + 1):
            hit = (bits >> U64(o)) & U64(1) == 1
            s = e.place[rows[hit]] - o
            cover(s, s)
        return np.cumsum(edge[:-1]) > 0


def _zipped(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzipped(b: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", span: int = 100, gram: int = 52, most_group: int = 20_000, chunk_bytes: int = 4_000_000, block_bytes: int = 16_000_000) -> DataFrame:
    """key, n_bytes, n_removed, spans (start and size of each maximal removed run) and kept (bytes: what is left of a character need
    not be text)."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"keys must be whole numbers, {key} is {docs.schema[key].dataType.simpleString()}")
    if not 0 < gram <= span or span - gram > 63 or span > 65535:
        raise ValueError("gram must be at most span, and less by 63 at most")
    total = text_size(docs, text)
    blocks = index_blocks(total, block_bytes)
    docs = docs.select(key, text)
    chunks = in_chunks(docs, total, key=key, text=text, chunk_bytes=chunk_bytes)
    blob = pa.binary()
    answer_type = "chunk int, step int, block int, codes binary"
    wide = 2 * span - gram

    def chunk_of(table: pa.Table) -> Chunk:
        return Chunk(table, key, text, span, gram, blocks)

    def messages(number: int, parts: list[tuple[int, slice]], **columns: list[bytes]) -> pa.Table:
        return pa.table({"block": pa.array([b for b, _ in parts], pa.int32()), "chunk": pa.array([number] * len(parts), pa.int32()), **{n: pa.array(v, blob) for n, v in columns.items()}})

    def answers(step: int, block: int, chunk: list[int], codes: list[bytes]) -> pa.Table:
        n = len(chunk)
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "step": pa.array([step] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "codes": pa.array(codes, blob)})

    def cuts(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        c = chunk_of(table)
        parts = c.parts(c.short << _SHORT)
        return messages(group[0].as_py(), parts, hashes=[squeeze(c.short[s], True) for _, s in parts], kinds=[squeeze(c.kinds[s].astype(U64)) for _, s in parts])

    def mark(group: tuple, table: pa.Table) -> pa.Table:
        parts = [expand(b.as_py(), True) for b in table.column("hashes")]
        kinds = np.concatenate([expand(b.as_py()) for b in table.column("kinds")]).astype(np.int64)
        _, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
        many = np.bincount(inverse, kinds) > most_group
        codes = np.where(many, 2, times > 1).astype(U64)[inverse]
        cut = cuts(parts)
        out = [(c, squeeze(codes[a:b])) for c, a, b in zip(table.column("chunk").to_pylist(), cut, cut[1:], strict=False) if codes[a:b].any()]
        return answers(1, group[0].as_py(), [c for c, _ in out], [m for _, m in out])

    def send(group: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        c = chunk_of(table)
        sent = c.sent(given)
        parts = c.parts(sent.hashes)
        columns = {"hashes": (sent.hashes, True), "others": (sent.others, False), "sources": (sent.keys, False), "places": (sent.places, False)}
        return messages(group[0].as_py(), parts, **{n: [squeeze(a[s].view(U64), up) for _, s in parts] for n, (a, up) in columns.items()})

    def compare(group: tuple, table: pa.Table) -> pa.Table:
        columns = [[expand(b.as_py(), n == "hashes") for b in table.column(n)] for n in ("hashes", "others", "sources", "places")]
        h, c, keys, places = (np.concatenate(x) for x in columns)
        keys, places = keys.view(np.int64), places.view(np.int64)
        order = np.lexsort((places, keys, c, h))
        fresh = np.ones(len(order), bool)
        fresh[1:] = h[order][1:] != h[order][:-1]
        other = fresh.copy()
        other[1:] |= c[order][1:] != c[order][:-1]
        kinds = np.bincount(np.cumsum(fresh) - 1, other)[np.cumsum(fresh) - 1]
        least = order[np.flatnonzero(other)][np.cumsum(other) - 1]
        late = (keys[order] > keys[least]) | (places[order] > places[least])
        codes = np.empty(len(order), U64)
        codes[order] = np.where(late, 1, np.where(kinds > 1, 2, 0))
        cut = cuts(columns[0])
        return answers(2, group[0].as_py(), table.column("chunk").to_pylist(), [squeeze(codes[a:b]) for a, b in zip(cut, cut[1:], strict=False)])

    def show(group: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        c = chunk_of(table)
        sent = c.sent(given)
        use = c.several(sent, c.aligned(given, 2, sent.hashes))
        parts = c.parts(sent.hashes[use])
        raw, *numbers = c.surroundings(sent, use)
        columns = {"sources": sent.keys[use], "places": sent.places[use], **dict(zip(("before", "after"), numbers, strict=True))}
        return messages(group[0].as_py(), parts, rows=[_zipped(raw[s]) for _, s in parts], **{n: [squeeze(a[s].astype(np.int64).view(U64)) for _, s in parts] for n, a in columns.items()})

    def sort(group: tuple, table: pa.Table) -> pa.Table:
        columns = {n: [expand(b.as_py()).view(np.int64) for b in table.column(n)] for n in ("sources", "places", "before", "after")}
        rows = np.concatenate([_unzipped(b.as_py(), np.uint8) for b in table.column("rows")]).reshape(-1, wide)
        cut = cuts(columns["sources"])
        keys, places, before, after = (np.concatenate(x) for x in columns.values())
        masks = found_earlier(rows, before, after, keys, places, span, gram)
        return answers(3, group[0].as_py(), table.column("chunk").to_pylist(), [squeeze(masks[a:b]) for a, b in zip(cut, cut[1:], strict=False)])

    def cut_out(group: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        c = chunk_of(table)
        sent = c.sent(given)
        codes = c.aligned(given, 2, sent.hashes)
        use = c.several(sent, codes)
        gone = c.gone(sent, codes, use, c.aligned(given, 3, sent.hashes[use]))
        left = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(~gone, out=left[1:])
        kept = pa.Array.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(left[c.offs].astype(np.int64)), pa.py_buffer(c.buf[~gone].tobytes())]).cast(blob)
        edge = np.zeros(len(gone) + 1, bool)
        edge[c.offs] = True
        before, behind = np.append(False, gone[:-1])[: len(gone)], np.append(gone[1:], False)[: len(gone)]
        start = np.flatnonzero(gone & (~before | edge[:-1]))
        end = np.flatnonzero(gone & (~behind | edge[1:])) + 1
        owner = np.searchsorted(c.offs, start, "right") - 1
        values = pa.StructArray.from_arrays([pa.array(start - c.offs[owner]), pa.array(end - start)], ["start", "size"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(table) + 1)), pa.int32()), values)
        size = np.diff(c.offs)
        return pa.table({key: table.column(key), "n_bytes": pa.array(size), "n_removed": pa.array(size - np.diff(left[c.offs])), "spans": spans, "kept": kept})

    texts = chunks.groupBy("chunk")
    marks = texts.applyInArrow(ask, "block int, chunk int, hashes binary, kinds binary").groupBy("block").applyInArrow(mark, answer_type).repartition("chunk")
    sent = texts.cogroup(marks.groupBy("chunk")).applyInArrow(send, "block int, chunk int, hashes binary, others binary, sources binary, places binary")
    known = marks.unionByName(sent.groupBy("block").applyInArrow(compare, answer_type)).repartition("chunk")
    shown = texts.cogroup(known.groupBy("chunk")).applyInArrow(show, "block int, chunk int, rows binary, sources binary, places binary, before binary, after binary")
    all_answers = known.unionByName(shown.groupBy("block").applyInArrow(sort, answer_type))
    spans = ArrayType(StructType().add("start", "long").add("size", "long"))
    schema = StructType([docs.schema[key]]).add("n_bytes", "long").add("n_removed", "long").add("spans", spans).add("kept", "binary")
    return texts.cogroup(all_answers.groupBy("chunk")).applyInArrow(cut_out, schema)
