"""Document fingerprints (operator 8): canonical exact digest.

The canonical form of a text is its NFKC normal form, case-folded, normalised again, with each run of white space as
one space and none at the ends. The fingerprint is xxh3-128 of that form's UTF-8 bytes. `copy_groups` groups by the
fingerprint and compares the bytes inside equal buckets, so two texts in one group always have one canonical form. Only
texts in buckets of two or more are shuffled for it.

Defined cases: a null text counts as empty; empty texts share one fingerprint; a null key sorts after all others (in
descending order) and stays null; rows with one key follow each other in the order of their texts' hashes; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.llm.tokens import _key_type
from brackwater.llm.words import bounded_batches, slices
from brackwater.session import cut_lineage


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(form: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form)


def fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_form: bool = False) -> DataFrame:
    """key and fingerprint of each text, and if asked for its canonical bytes: compressed, for they are only compared, and equal
    bytes are compressed alike."""
    import zstandard

    kind, arrow = _key_type(docs, key)
    names = [key, "fingerprint"] + ["canonical"] * with_form
    schema = pa.schema(list(zip(names, (arrow, pa.string(), pa.binary()), strict=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress if with_form else None
        for batch in batches:
            for part in slices(batch, text):
                forms = [canonical(t) for t in part.column(text).to_pylist()]
                columns = [part.column(key), pa.array([digest(f) for f in forms], pa.string())]
                columns += [pa.array([pack(f) for f in forms], pa.binary())] if pack else []
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint string" + ", canonical binary" * with_form)


MOST_BROADCAST = 500_000  # fingerprints of 32 hexadecimal digits: some 50 MB in a worker


def copy_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """fingerprint, canonical (compressed canonical bytes; null for a text without copies), class_id (least key) and n_copies
    of each group of texts with one canonical form.

    First the fingerprints alone are counted. Those that occur again, if `most_broadcast` or fewer, are broadcast and pick
    their texts where they lie; if more, texts are joined by shuffle. Spark's grouping then hashes the wide fingerprint
    and compares the bytes inside equal buckets, and its map-side combine leaves one row of a group for each task.
    """
    digests = fingerprint(docs, key=key, text=text).groupBy("fingerprint").agg(F.min(key).alias("class_id"), F.count("*").alias("n_copies"))
    digests = cut_lineage(digests)
    again = digests.filter("n_copies > 1").select("fingerprint")
    few = again.limit(most_broadcast + 1).count() <= most_broadcast
    forms = fingerprint(docs, key=key, text=text, with_form=True).join(F.broadcast(again) if few else again, "fingerprint", "left_semi")
    groups = forms.groupBy("fingerprint", "canonical").agg(F.min(key).alias("class_id"), F.count("*").alias("n_copies"))
    alone = digests.filter("n_copies = 1").select("fingerprint", F.lit(None).cast("binary").alias("canonical"), "class_id", "n_copies")
    return groups.unionByName(alone)


def _partitions(docs: DataFrame, text: str, part_bytes: int = 8_000_000, most: int = 20_000) -> int:
    """Range partitions of `part_bytes`, but `most` of them: partitions are sorted with spilling and read as streams, so larger ones
    cost time, not memory, where a scheduler would not survive a task for every 8 MB of a large corpus."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(most, max(1, total // part_bytes))


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of each text, of its edited form, and how each is like the other and like the next document's.

    Edited: the last floor(n / share) code points are replaced by as many first ones of the next document in descending
    key order; the last document's next is the first. One shuffle ranges the rows by key; each partition is read as a
    stream, and only its last row is joined with the first row of the partition that follows (two rows a partition).
    Returns key, n_chars, edited (sha-256 is left to the caller: `edited_sha256`), fingerprint, edited_fingerprint,
    near_edited, near_next (1.0 for equal fingerprints of equal canonical bytes, else 0.0).
    """
    import hashlib

    kind, arrow = _key_type(docs, key)
    fields = [(key, arrow), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema([*fields, ("place", pa.int32()), ("part", pa.int32()), ("edge", pa.string())])
    ddl = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finished(k, own: str, form: bytes, after: str, next_form: bytes) -> tuple:
        n = len(own)
        take = n // share
        edited = own[: n - take] + after[:take]
        same = edited == own
        other = form if same else canonical(edited)
        mark = digest(form)
        other_mark = mark if other == form else digest(other)
        return k, n, hashlib.sha256(edited.encode()).hexdigest(), mark, other_mark, float(mark == other_mark and form == other), float(form == next_form)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = None
        for batch in batches:
            for piece in slices(batch, text):
                rows = []
                for k, t in zip(piece.column(key).to_pylist(), piece.column(text).to_pylist(), strict=True):
                    t = t or ""
                    form = canonical(t)
                    if before is None:
                        rows.append((k, None, None, None, None, None, None, 1, part, t))
                    else:
                        rows.append((*finished(*before, t, form), 0, part, None))
                    before = (k, t, form)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if before is not None:
            row = (before[0], None, None, None, None, None, None, 2, part, before[1])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [finished(k, t, canonical(t), after, canonical(after)) for k, t, after in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[:7], strict=True)], schema=pa.schema(fields))

    order = [F.col(key).desc_nulls_last(), F.xxhash64(text)]
    ranged = bounded_batches(docs).select(key, text).repartitionByRange(_partitions(docs, text), *order).sortWithinPartitions(*order)
    streamed = cut_lineage(ranged.mapInArrow(stream, f"{ddl}, place int, part int, edge string"))
    done = streamed.filter("place = 0").drop("place", "part", "edge")
    firsts = streamed.filter("place = 1").select("part", F.col("edge").alias("after"))
    lasts = streamed.filter("place = 2").select(F.col(key).alias("key"), F.col("edge").alias("own"), "part")
    pairs = lasts.join(following(firsts.select("part")), "part").drop("part").join(firsts.withColumnRenamed("part", "next"), "next")
    return done.unionByName(pairs.select("key", "own", "after").mapInArrow(join_edges, ddl))


def following(parts: DataFrame, bucket: int = 1024) -> DataFrame:
    """part and next (the least larger one; of the largest, the least of all) of distinct numbers `part`. Numbers follow one
    another inside buckets, buckets by a table with one row a bucket."""
    parts = parts.withColumn("bucket", F.floor(F.col("part") / bucket))
    heads = parts.groupBy("bucket").agg(F.min("part").alias("head"))
    w = Window.partitionBy(F.lit(1)).orderBy("bucket")
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(w), F.first("head").over(w)).alias("head"))
    inside = F.lead("part").over(Window.partitionBy("bucket").orderBy("part"))
    return parts.withColumn("inside", inside).join(heads, "bucket").select("part", F.coalesce("inside", "head").alias("next"))


def compared(docs: DataFrame, *, key: str = "doc_id", text: str = "text", share: int = 3, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """`edited_fingerprints`, with class_id (least key) and n_copies of each text's group, from `copy_groups`. Should two
    canonical forms have one fingerprint, n_forms is above 1 and both are null: the groups then tell them apart by bytes only.

    Only groups of two or more are joined, by broadcast where they are few, so no shuffle meets a hot fingerprint there.
    """
    groups = copy_groups(docs, key=key, text=text, most_broadcast=most_broadcast).filter("canonical IS NOT NULL")
    one = F.count("*") == 1
    groups = cut_lineage(groups.groupBy("fingerprint").agg(F.count("*").alias("n_forms"), *[F.when(one, F.min(c)).alias(c) for c in ("class_id", "n_copies")]))
    few = groups.limit(most_broadcast + 1).count() <= most_broadcast
    found = edited_fingerprints(docs, key=key, text=text, share=share).join(F.broadcast(groups) if few else groups, "fingerprint", "left")
    alone = F.col("n_forms").isNull()
    return found.withColumns({"class_id": F.when(alone, F.col(key)).otherwise(F.col("class_id")), "n_copies": F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n_copies")), "n_forms": F.coalesce("n_forms", F.lit(1).cast("long"))})
