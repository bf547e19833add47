"""Periodic runs of words (operator 13): Crochemore's partition refinement, many documents at once.

Positions of a document are classed by the factor of `level` words that begins there. A level comes from the one before by
splitting: of the parts into which a class falls all but the largest (the smaller halves) are refiners, and only positions
just before a refiner's members are looked at, so every position is moved a logarithmic number of times and classes that do
not split cost nothing. Members of a class are linked in the order of position. Neighbours at a distance of `level` words are a
square with a primitive root; squares at consecutive positions are one run, and its period is the least one.

All documents of a slice of bounded bytes are refined together in numpy, within the task that reads them: nothing is
shuffled, and no document meets another. A document leaves the refinement when its remaining repeated positions are too few
for a run of a longer period, or when the period is too long for its words.

Defined cases: a null text has no words, no runs and an empty rest; a text of any length is worked through whole (a slice of
its own, about 200 bytes of memory a word); repeated rows have equal results; an empty table gives an empty table; columns
not asked for are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from brackwater.llm.substrings import kept_texts
from brackwater.llm.words import U64, Spans, bounded_batches, find_words, mix, slices, text_bytes

SLICE_BYTES = 3_000_000


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] of them), one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def equal_words(spans: Spans, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether words a[i] and b[i] have the same bytes, for all i."""
    size = spans.end[a] - spans.start[a]
    if (size != spans.end[b] - spans.start[b]).any():
        return False
    return bool((spans.buf[_places(spans.start[a], size)] == spans.buf[_places(spans.start[b], size)]).all())


def word_classes(spans: Spans) -> np.ndarray:
    """A number for each word, equal for equal words of one document and no others. Hashes are checked byte by byte."""
    doc = spans.doc
    keys = mix(spans.hashes() ^ mix(doc.astype(U64)))
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    same = np.flatnonzero(~fresh)
    if len(same) and ((doc[order[same]] != doc[order[same - 1]]).any() or not equal_words(spans, order[same], order[same - 1])):
        whole = list(zip(doc.tolist(), spans.strings(np.arange(len(doc))), strict=True))  # two words with one hash
        numbers: dict[tuple, int] = {}
        return np.array([numbers.setdefault(w, len(numbers)) for w in whole], np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


class _Classes:
    """Classes of positions: each is a block of `sa`, named by where the block begins, and a list linked by position."""

    def __init__(self, first: np.ndarray):
        n = len(first)
        self.none = n
        self.sa = np.argsort(first, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = first[self.sa][1:] != first[self.sa][:-1]
        begin = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begin, n))
        self.at, self.of = np.empty(n, np.int64), np.empty(n, np.int64)
        self.at[self.sa] = np.arange(n)
        self.of[self.sa] = np.repeat(begin, sizes)
        self.size = np.zeros(n + 1, np.int64)
        self.size[begin] = sizes
        self.next, self.prev = np.full(n + 1, n), np.full(n + 1, n)
        self.removed = np.zeros(n, bool)
        inner = np.flatnonzero(~fresh)
        self.link(self.sa[inner - 1], self.sa[inner])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.next[a], self.prev[b] = b, a

    def split(self, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """Splits classes by the class of the next position, for `pos` whose next positions are members of refiners. Returns
        the refiners' members of the next level, both ends of the new links, and the positions that are alone now."""
        none = np.zeros(0, np.int64)
        own, after = self.of[pos], self.of[pos + 1]
        order = np.lexsort((pos, own * (self.none + 1) + after))
        pos, own, after = pos[order], own[order], after[order]
        fresh = np.ones(len(pos), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(pos)))
        stays = np.repeat(length, length) == self.size[own]  # the whole class moves together: no split
        if stays.any():
            pos, own, fresh = pos[~stays], own[~stays], fresh[~stays]
            begin = np.flatnonzero(fresh)
            length = np.diff(np.append(begin, len(pos)))
        if not len(pos):
            return none, none, none, none
        head = np.ones(len(begin), bool)  # the groups that are the first of their class
        head[1:] = own[begin][1:] != own[begin][:-1]
        heads = np.flatnonzero(head)
        block = own[begin[heads]]
        moved = np.add.reduceat(length, heads)
        rest = self.size[block] - moved
        # out of the old lists
        by_place = np.lexsort((pos, own))
        r = pos[by_place]
        cut = np.ones(len(r), bool)
        cut[1:] = self.next[r[:-1]] != r[1:]
        starts = np.flatnonzero(cut)
        before, behind = self.prev[r[starts]], self.next[r[np.append(starts[1:], len(r)) - 1]]
        self.next[before], self.prev[behind] = behind, before
        bridged = (before != self.none) & (behind != self.none)
        # into new ones
        inner = np.flatnonzero(~fresh)
        self.prev[pos[begin]] = self.none
        self.next[pos[np.append(begin[1:], len(pos)) - 1]] = self.none
        self.link(pos[inner - 1], pos[inner])
        links_a, links_b = np.concatenate([before[bridged], pos[inner - 1]]), np.concatenate([behind[bridged], pos[inner]])
        # to the end of their blocks
        self.removed[pos] = True
        tail = _places(block + rest, moved)
        held = self.at[pos]
        holes = held[held < np.repeat(block + rest, moved)]
        left = self.sa[tail]
        left = left[~self.removed[left]]
        self.sa[holes], self.at[left] = left, holes
        self.sa[tail], self.at[pos] = pos, tail
        self.removed[pos] = False
        name = tail[begin]
        self.of[pos] = np.repeat(name, length)
        self.size[block] = rest
        self.size[name] = length
        # all parts but the largest refine the next level
        largest = np.maximum.reduceat(length, heads)
        per_class = np.diff(np.append(heads, len(begin)))
        rest_wins = rest >= largest
        is_top = (length == np.repeat(largest, per_class)) & ~np.repeat(rest_wins, per_class)
        tops = np.flatnonzero(is_top)
        again = np.zeros(len(tops), bool)
        group_class = np.repeat(np.arange(len(heads)), per_class)
        again[1:] = group_class[tops][1:] == group_class[tops][:-1]
        use = np.ones(len(begin), bool)
        use[tops[~again]] = False
        few = ~rest_wins & (rest > 0)
        refiners = np.concatenate([pos[np.repeat(use, length)], self.sa[_places(block[few], rest[few])]])
        alone = np.concatenate([pos[begin[length == 1]], self.sa[block[rest == 1]]])
        return refiners, links_a, links_b, alone


def find_runs(words: np.ndarray, ptr: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, ...]:
    """Runs of all documents (words[ptr[d]:ptr[d+1]], numbered so that equal numbers are equal words of one document):
    document, start, length and period, by document, start and period. A run has `least` words and `exponent` (2 at least) periods or more."""
    docs = len(ptr) - 1
    sizes = np.diff(ptr)
    doc = np.repeat(np.arange(docs), sizes + 1)  # one more position a document: an end that equals nothing
    first = np.arange(docs) + ptr[:-1]
    values = np.empty(len(doc), np.int64)
    ends = first + sizes
    inside = np.ones(len(doc), bool)
    inside[ends] = False
    values[inside] = words
    values[ends] = (words.max() + 1 if len(words) else 0) + np.arange(docs)
    limit = sizes // exponent
    classes = _Classes(values)
    alive = np.bincount(doc[classes.size[classes.of] > 1], minlength=docs)
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)

    def wait(a: np.ndarray, b: np.ndarray, level: int) -> None:
        gap = b - a
        use = (gap >= level) & (gap <= limit[doc[a]])
        a, gap = a[use], gap[use]
        if not len(a):
            return
        order = np.argsort(gap, kind="stable")
        a, gap = a[order], gap[order]
        cut = np.flatnonzero(np.append(True, gap[1:] != gap[:-1]))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(a)], strict=True):
            waiting[int(gap[x])].append(a[x:y])

    found = []

    def squares(level: int, refined: np.ndarray) -> None:
        if level not in waiting:
            return
        at = np.unique(np.concatenate(waiting.pop(level)))
        at = at[refined[doc[at]] & (classes.next[at] == at + level)]
        if not len(at):
            return
        cut = np.flatnonzero(np.append(True, np.diff(at) != 1))
        begin, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
        length = last - begin + 2 * level
        good = length >= max(least, exponent * level)
        found.append((begin[good], length[good], np.full(int(good.sum()), level)))

    linked = np.flatnonzero(classes.next[:-1] != classes.none)
    wait(linked, classes.next[linked], 1)
    level, moved = 1, np.arange(len(doc))
    squares(1, limit > 0)
    most = int(limit.max()) if docs else 0
    while len(moved) and level < most:
        # a run of period q > level with e > 2 periods has q * e - level + 1 repeated positions or more; with two, the ends alone
        active = (limit > level) & (alive >= (exponent * (level + 1) - level + 1 if exponent > 2 else 4))
        use = active[doc[moved]] & (moved != first[doc[moved]])
        pos = moved[use] - 1
        pos = pos[classes.size[classes.of[pos]] > 1]
        if not len(pos):
            break
        moved, a, b, alone = classes.split(pos)
        level += 1
        np.subtract.at(alive, doc[alone], 1)
        wait(a, b, level)
        squares(level, active)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    owner = doc[start]
    start = start - first[owner]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period) and collapsed_text: the words that no run contains
    after its first period, joined by one space."""
    run = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = StructType([docs.schema[key]]).add("n_words", "long").add("runs", ArrayType(run)).add("collapsed_text", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                spans = find_words(*text_bytes(part.column(text)))
                owner, start, length, period = find_runs(word_classes(spans), spans.ptr, exponent, least)
                gone = np.zeros(len(spans.start) + 1, np.int64)
                begin = spans.ptr[owner] + start
                np.add.at(gone, begin + period, 1)
                np.add.at(gone, begin + length, -1)
                raw, cut = kept_texts(spans, np.cumsum(gone[:-1]) == 0)
                texts = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())
                values = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32()), values)
                yield pa.record_batch([part.column(key), pa.array(np.diff(spans.ptr)), lists, texts], [key, "n_words", "runs", "collapsed_text"])

    return bounded_batches(docs).select(key, text).mapInArrow(work, schema)
