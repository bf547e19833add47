"""N-gram Jaccard join (operator 7): MinHash banding, candidates verified on full n-gram sets.

1. Each text becomes the set of its word n-grams (64-bit hashes) and a MinHash signature; rows with equal sets form one
   class before anything is compared (map-side combine), so exact copies never meet in pairs.
2. `bands_for` chooses band and row counts for the target recall at the threshold. Classes are shuffled on band hashes;
   only hashes that several classes share go on. A bucket whose members already share an earlier band is dropped.
3. A bucket is dealt by a hash into blocks of bounded rows and bytes, and each pair of blocks is one task, worked through
   in tiles: the full n-gram sets of its members are intersected, and a pair is counted in the first band it shares only.
   What leaves the task is one row a member (links and the root of its local component), never a row a pair. A set travels
   once for each block of its bucket; nearly all buckets are one block.
4. Components of the links are found by hooking and pointer jumping with reliable checkpoints, until no label changes.

Rows and sets are told apart by 128 bits throughout: a set's representative is the pair of hashes of its least row.

Defined cases: a text of one to n-1 words has one n-gram, all its words; a null text or one without words has no n-grams,
no link, and is a class of its own; repeated rows are members of one class; a null key is larger than all others;
unlike texts that share a key (or have none) share a class_id, not a root; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.llm.words import U64, bounded_batches, find_words, mix, rolling, slices, text_bytes, whole
from brackwater.session import cut_lineage

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
ROW, CHECK = "_brackwater_row_id", "_brackwater_row_check"


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 128) -> tuple[int, int]:
    """Bands and rows: as many bands as a pair at the threshold needs to share one with probability `recall`, and the most rows
    (so the fewest candidates below the threshold) with which that takes at most `hashes` hashes; one row, if none does."""

    def needed(rows: int) -> int:
        share = threshold**rows
        return int(np.ceil(np.log(1 - recall) / np.log1p(-share))) if share < 1 else 1

    fits = [r for r in range(1, hashes + 1) if needed(r) * r <= hashes]
    rows = max(fits, default=1)
    return needed(rows), rows


def ngram_sets(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending within a text, and pointers by text."""
    words = find_words(*text_bytes(texts))
    h, sizes = words.hashes(), np.diff(words.ptr)
    at = np.flatnonzero(whole(words, n))
    grams, doc = rolling(h, n)[at], words.doc[at]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    few = [mix(np.add.reduce(mix(h[words.ptr[d] : words.ptr[d + 1]] + np.arange(sizes[d], dtype=U64)), keepdims=True) + U64(sizes[d])) for d in short]
    if few:
        grams, doc = np.concatenate([grams, *few]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(sizes) + 1))


def signatures(grams: np.ndarray, ptr: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, and its band hashes; texts without n-grams get zeros."""
    n = len(ptr) - 1
    full = np.flatnonzero(np.diff(ptr))
    marks, out = np.zeros((n, 2), U64), np.zeros((n, bands), U64)
    if len(full):
        begin = ptr[full]
        marks[full, 0] = mix(np.add.reduceat(mix(grams ^ U64(0x51)), begin))
        marks[full, 1] = mix(np.add.reduceat(mix(grams ^ U64(0xA7)), begin))
        seeds = np.random.default_rng(7).integers(1, 2**63, (bands * rows, 2), dtype=U64)
        for b in range(bands):
            band = np.full(len(full), U64(b + 1))
            for r in range(rows):
                mul, add = seeds[b * rows + r]
                band = mix(band * U64(31) + np.minimum.reduceat((grams ^ add) * (mul | U64(1)) >> U64(8), begin))
            out[full, b] = band
    return marks, out


def _row_id(key: str, text: str) -> F.Column:
    return F.xxhash64(F.col(key), F.col(text))


def _row_check(key: str, text: str) -> F.Column:
    """A second hash: with it rows have 128 bits, so that no two documents are taken for one."""
    return F.xxhash64(F.lit(77), F.col(text), F.col(key))


_REP = "struct<id: bigint, check: bigint>"


def _both(id: str | Column, check: str | Column) -> Column:
    """The two hashes of a row as one ordered value."""
    one = lambda c, name: (F.col(c) if isinstance(c, str) else c).alias(name)
    return F.struct(one(id, "id"), one(check, "check"))


def sign(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = NGRAM, bands: int, rows: int) -> DataFrame:
    """row_id, row_check, key, the set's two hashes (`set_a`, `set_b`), n_grams and band hashes of each whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    schema = pa.schema([("row_id", pa.int64()), ("row_check", pa.int64()), (key, to_arrow_type(kind)), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                grams, ptr = ngram_sets(part.column(text), n)
                marks, own = signatures(grams, ptr, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * bands, pa.int32()), pa.array(own.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("row_check"), part.column(key), *(pa.array(np.ascontiguousarray(m).view(np.int64)) for m in marks.T), pa.array(np.diff(ptr)), lists], schema=schema)

    return bounded_batches(docs).select(_row_id(key, text).alias("row_id"), _row_check(key, text).alias("row_check"), key, text).mapInArrow(run, f"row_id long, row_check long, `{key}` {kind.simpleString()}, set_a long, set_b long, n_grams long, bands array<long>")


def _overlaps(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, over bounded runs of the n-grams that several have."""
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    ids = np.cumsum(fresh) - 1
    common = np.bincount(ids)[ids] > 1
    ids, owner = ids[common], owner[common]
    ids = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) if len(ids) else ids
    out = np.zeros((len(left), len(right)), np.float32)
    top = int(ids[-1]) + 1 if len(ids) else 0
    for lo in range(0, top, columns):
        a, b = np.searchsorted(ids, [lo, lo + columns])
        grid = np.zeros((len(grams), min(columns, top - lo)), np.float32)
        grid[owner[a:b], ids[a:b] - lo] = 1
        out += grid[left] @ grid[right].T
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's component over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(members: list[np.ndarray], band: int, bands: np.ndarray, sides: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (weighted, and by set) and local root of each member of a pair of blocks (sides 0 and 1; all 0: a block with itself)."""
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1) if sides.any() else left
    size = np.array([len(g) for g in members], np.float64)
    both = _overlaps(members, left, right).astype(np.float64)
    alike = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
    for b in range(band):  # a pair is counted in the first band it shares
        alike &= bands[left, b][:, None] != bands[right, b][None, :]
    if not sides.any():
        np.fill_diagonal(alike, False)
    i, j = np.nonzero(alike)
    n = len(members)
    links = np.bincount(left[i], weight[right[j]], n)
    sets = np.bincount(left[i], minlength=n).astype(float)
    if sides.any():
        links += np.bincount(right[j], weight[left[i]], n)
        sets += np.bincount(right[j], minlength=n)
    return links, sets, _roots(n, left[i], right[j])


def tiled_links(members: list[np.ndarray], band: int, bands: np.ndarray, sides: np.ndarray, weight: np.ndarray, threshold: float, tile: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`block_links` over tiles of `tile` members a side, so that memory does not grow with the square of a block."""
    n = len(members)
    links, sets, root = np.zeros(n), np.zeros(n), np.arange(n)
    cut = lambda at: [at[i : i + tile] for i in range(0, len(at), tile)]
    left, right = cut(np.flatnonzero(sides == 0)), cut(np.flatnonzero(sides == 1))
    pairs = [(x, y) for x in left for y in right] if right else [(x, y) for i, x in enumerate(left) for y in left[i:]]
    for x, y in pairs:
        own = x if y is x else np.concatenate([x, y])
        side = np.zeros(len(own), int) if y is x else np.repeat([0, 1], [len(x), len(y)])
        some, found, local = block_links([members[i] for i in own], band, bands[own], side, weight[own], threshold)
        links[own] += some
        sets[own] += found
        root = _roots(n, np.concatenate([np.arange(n), own]), np.concatenate([root, own[local]]))
    return links, sets, root


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) from edges (a, b) of any ordered type. Each round hooks labels over the edges, then
    jumps; labels only fall, so it ends when a round changes none."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("further"))
        jumped = hooked.join(up, hooked.new == up["at"], "left").select("node", F.least("new", F.coalesce("further", "new")).alias("root"), "old")
        jumped = cut_lineage(jumped)
        changed = not jumped.filter("root <> old").isEmpty()
        labels = jumped.select("node", "root")
        if not changed:
            return labels


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = 2048, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: row_id and row_check (hashes of key and text), key, class_id (least key of its component), root (both
    hashes of the least row of its component; unlike class_id no two components share one), n_links (other documents alike at
    the threshold) and n_set_links (other n-gram sets alike). `block` rows or `block_bytes` of n-grams are expected in a block."""
    bands, rows = bands_for(threshold, recall)
    signed = cut_lineage(sign(docs, key=key, text=text, n=n, bands=bands, rows=rows))
    sets = signed.filter("n_grams > 0").groupBy("set_a", "set_b").agg(F.min(_both("row_id", "row_check")).alias("rep"), F.min(key).alias("least"), F.count("*").alias("weight"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    sets = cut_lineage(sets)

    banded = sets.select("rep", "n_grams", F.posexplode("bands").alias("band", "hash"))
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n_grams") * 8 / block_bytes)).cast("int").alias("blocks")
    shared = banded.groupBy("band", "hash").agg(F.count("*").alias("n"), blocks).filter("n > 1").drop("n")
    members = banded.drop("n_grams").join(shared, ["band", "hash"]).join(sets.select("rep", "bands", "weight"), "rep")
    # a bucket whose members all share an earlier band has no pair of its own
    stale = members.groupBy("band", "hash").agg(*[(F.min(F.col("bands")[i]) == F.max(F.col("bands")[i])).alias(f"s{i}") for i in range(bands)])
    flags = F.array(*[F.col(f"s{i}") for i in range(bands)])
    stale = stale.filter(F.exists(F.slice(flags, F.lit(1), F.col("band")), lambda x: x)).select("band", "hash")
    members = cut_lineage(members.join(stale, ["band", "hash"], "left_anti"))

    kind = docs.select(_both(_row_id(key, text), _row_check(key, text)).alias("rep"), F.col(text).alias("text"))
    wanted = kind.join(members.select("rep").distinct(), "rep", "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, ptr = ngram_sets(part.column("text"), n)
                blobs = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((ptr * 8).astype(np.int32)), pa.py_buffer(grams.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("rep"), blobs], ["rep", "grams"])

    grams = wanted.mapInArrow(to_sets, f"rep {_REP}, grams binary")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    pairs = members.join(grams, "rep").withColumn("own", own)
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def link(group: tuple, table: pa.Table) -> pa.Table:
        if group[2] != group[3] and pc.count_distinct(table.column("own")).as_py() < 2:  # the other block is empty
            table = table.slice(0, 0)
        named = lambda rows: pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(rows.T)], ["id", "check"])
        ids = table.column("rep").combine_chunks()
        pairs = np.stack([ids.field(name).to_numpy() for name in ("id", "check")], 1)
        reps, first = np.unique(pairs, axis=0, return_index=True)  # a repeated row brings its set twice
        table = table.take(pa.array(first))
        members = [np.frombuffer(b, U64) for b in table.column("grams").to_pylist()]
        sides = (table.column("own").to_numpy() != group[2].as_py()).astype(int)
        own = np.array(table.column("bands").to_pylist())
        if not members:
            return pa.table({"rep": named(reps), "links": pa.array([], pa.int64()), "sets": pa.array([], pa.int64()), "root": named(reps)})
        links, found, root = tiled_links(members, group[0].as_py(), own, sides, table.column("weight").to_numpy(), threshold)
        some = found > 0
        return pa.table({"rep": named(reps[some]), "links": links[some].astype(np.int64), "sets": found[some].astype(np.int64), "root": named(reps[root[some]])})

    linked = pairs.select("band", "hash", "i", "j", "rep", "own", "bands", "weight", "grams").groupBy("band", "hash", "i", "j").applyInArrow(link, f"rep {_REP}, links long, sets long, root {_REP}")
    linked = cut_lineage(linked)
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("sets").alias("n_set_links"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = sets.join(roots, sets.rep == roots.node, "left").withColumn("root", F.coalesce("root", "rep")).join(counts, "rep", "left")
    least = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = joined.join(least, "root").select("set_a", "set_b", "class_id", "root", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"))
    alone = signed.filter("n_grams = 0").select("row_id", "row_check", key, F.col(key).alias("class_id"), _both("row_id", "row_check").alias("root"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_set_links"))
    rest = signed.filter("n_grams > 0").join(classes, ["set_a", "set_b"]).select("row_id", "row_check", key, "class_id", "root", "n_links", "n_set_links")
    named = F.concat(F.hex("root.id"), F.lit("-"), F.hex("root.check"))
    return rest.unionByName(alone).withColumn("root", named)


def one_of_each(docs: DataFrame, joined: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their component: of each root the least key, of rows with that key the least row id.
    Components that share their least key, or have none but nulls, keep a row each."""
    same = F.col(key).eqNullSafe(F.col("class_id"))
    # texts without n-grams are classes of their own, unless rows repeat
    least = F.min(F.struct("row_id", "row_check")).alias("least")
    keepers = joined.filter(same).groupBy("root").agg(least).select(F.col("least.row_id").alias(ROW), F.col("least.row_check").alias(CHECK))
    found = docs.withColumns({ROW: _row_id(key, text), CHECK: _row_check(key, text)}).join(keepers, [ROW, CHECK], "left_semi")
    return found.dropDuplicates([ROW, CHECK]).drop(ROW, CHECK)
