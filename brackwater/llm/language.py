"""Language ID (operator 1): compression classification.

Each language has a zstandard raw-content dictionary of its own training texts. A text is encoded once with every
dictionary; the language whose dictionary gives the smallest result is chosen. If the runner-up is within `margin`
bytes, the choice is marked as rejected. Letters are compared in ASCII lower case and all other ASCII characters count
as spaces, so that shouting or signs between words do not hide the language.

Learning takes a bounded sample (`sample_rows` expected texts and `dictionary_bytes` for each language, which is the bound of
what reaches the driver at every input size); every text is
classified whole. Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the language
first in alphabetical order and are rejected; with no training rows everything is `und`; rows with a null language
teach nothing; repeated rows get equal answers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.llm.tokens import _key_type
from brackwater.llm.words import best_of, bounded_batches, slices, text_bytes

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[0x80:] = np.arange(0x80, 256)


def folded(texts: pa.Array) -> list[bytes]:
    """Each text with ASCII letters in lower case and other ASCII characters as single spaces."""
    buf, offs = text_bytes(texts)
    buf = _LETTERS[buf]
    keep = np.ones(len(buf), bool)
    if len(buf):
        keep[1:] = (buf[1:] != 0x20) | (buf[:-1] != 0x20)
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    raw, cut = buf[keep].tobytes(), at[offs].tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def fit_dictionaries(train: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", dictionary_bytes: int = 65_536, sample_rows: int = 150, most_chars: int = 4000, most_languages: int = 1000) -> dict[str, bytes]:
    """Language -> dictionary, for the `most_languages` commonest values. `sample_rows` texts of each are expected, chosen by a
    hash of key and text; of a long one the dictionary takes `most_chars` characters from a place chosen by hash, so that it
    holds many texts."""
    train = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in best_of(train.groupBy(lang).agg(F.count("*").alias("n")), most_languages, F.desc("n"), lang).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample_rows / n)])
    chosen = F.xxhash64(F.col(key), F.col(text), F.lit(17)) / F.lit(2.0**64) + 0.5 < share[F.col(lang)]
    begin = F.pmod(F.xxhash64(F.col(text), F.lit(23)), F.greatest(F.lit(1), F.length(text) - most_chars + 1)).cast("int")
    rows = train.filter(chosen).select(lang, F.substring(F.col(text), begin + 1, F.lit(most_chars)).alias("text"), F.xxhash64(key, F.lit(5)).alias("at")).toPandas()
    out = {}
    for name, own in rows.sort_values(["at", "text"]).groupby(lang):
        whole = b" ".join(folded(pa.array(own["text"])))
        if whole.strip():
            out[name] = whole[-dictionary_bytes:]
    return out


class Classifier:
    """The dictionaries' coders, for use inside a task."""

    def __init__(self, dictionaries: dict[str, bytes], margin: int = 1, level: int = 9, second_level: int = 3, narrow: int = 4):
        import zstandard

        def coder(content: bytes, strength: int):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=strength)
            return zstandard.ZstdCompressor(dict_data=own, level=strength, write_content_size=False, write_checksum=False).compress

        self.names = sorted(dictionaries)
        self.margin, self.narrow = margin, narrow
        self.first, self.second = ([coder(dictionaries[n], x) for n in self.names] for x in (level, second_level))

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, lead in bytes, and whether the choice is rejected, of each whole text.

        Where the lead is under `narrow` bytes, the sizes at the second level are added before choosing.
        """
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        pred, lead = [], []
        for some, raw in zip(letters, folded(texts), strict=True):
            if not some or not self.first:
                pred.append("und")
                lead.append(0)
                continue
            sizes = [len(c(raw)) for c in self.first]
            best = min(sizes)
            if sum(x < best + self.narrow for x in sizes) > 1:
                sizes = [x + len(c(raw)) for x, c in zip(sizes, self.second, strict=True)]
                best = min(sizes)
            at = sizes.index(best)
            sizes[at] = 1 << 60
            pred.append(self.names[at])
            lead.append(min(sizes) - best if len(sizes) > 1 else len(raw))
        lead = np.array(lead, np.int64)
        return pred, lead, lead < self.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, key: str = "doc_id", text: str = "text", margin: int = 1) -> DataFrame:
    """key, lang_pred, score (0 to 1, from the lead over the runner-up), lead (bytes), rejected."""
    kind, arrow = _key_type(docs, key)
    schema = pa.schema([(key, arrow), ("lang_pred", pa.string()), ("score", pa.float64()), ("lead", pa.int64()), ("rejected", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value, margin)
        for batch in batches:
            for part in slices(batch, text):
                pred, lead, rejected = classifier.decide(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(pred, pa.string()), pa.array(lead / (lead + 4.0)), pa.array(lead), pa.array(rejected)], schema=schema)

    return bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, lead long, rejected boolean")


def keep_sure(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text", margin: int = 1) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value, margin)
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(~classifier.decide(part.column(text))[2]))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key's text, modulo `folds`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds
