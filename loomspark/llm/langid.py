"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.shipping import map_arrow

#: The bounded training sample: texts for each language, bytes taken of each, and languages at most.
TEXTS, TEXT_BYTES, LANGUAGES = 64, 1536, 256
#: Texts are encoded whole, in blocks of so many bytes, each against the dictionary.
BLOCK = 4096
#: Texts whose best encoding is less than this share smaller than the next best are rejected.
MARGIN = 0.004
#: Matches of four bytes, as the parts of words are short.
_SEARCH = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 18, "chain_log": 16, "hash_log": 17, "search_log": 3, "write_content_size": False, "write_dict_id": False}

_OTHER = regex.compile(r"[^\p{L}]+")


def letters_of(text: str | None) -> bytes:
    """The text's letters in lower case, all else as single spaces."""
    return _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8", "ignore")


@dataclass(frozen=True)
class Model:
    """A raw-content dictionary for each language, and the number of its labelled texts."""

    dictionaries: dict[str, bytes]
    counts: dict[str, int]


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3: such rows are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Dictionaries from a bounded sample: for each language the first TEXT_BYTES bytes of TEXTS texts, chosen by a hash of the id.

    Rows with a null label, text or id, or without a letter, aren't sampled. At
    most TEXTS rows of each of LANGUAGES languages reach the driver; more
    languages are an error.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).rlike(r"\p{L}"))
    small = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.encode(F.substring(text_col, 1, TEXT_BYTES), "UTF-8").alias("text"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    sample = small.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TEXTS).limit(TEXTS * LANGUAGES + 1).collect()
    if len({r["lang"] for r in sample}) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    texts: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["r"])):
        texts.setdefault(r["lang"], []).append(letters_of(bytes(r["text"]).decode("utf-8", "ignore"))[:TEXT_BYTES])
    learnt = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in learnt.groupBy(F.col(lang_col).cast("string")).count().limit(LANGUAGES + 1).collect()}
    return Model({lang: b" ".join(parts) for lang, parts in texts.items()}, counts)


class Encoder:
    """Encoded sizes of a text under each language's dictionary."""

    def __init__(self, model: Model):
        self.languages = sorted(model.dictionaries, key=lambda lang: (-model.counts.get(lang, 0), lang))
        self.compressors = []
        for lang in self.languages:
            held = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**_SEARCH)
            held.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress)

    def sizes(self, text: bytes) -> list[int]:
        if len(text) <= BLOCK:
            return [len(f(text)) for f in self.compressors]
        blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
        return [sum(len(f(b)) for b in blocks) for f in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is wide enough."""
        letters = letters_of(text)
        if not letters or not self.languages:
            return "und", 0.0, False
        sizes = self.sizes(letters)
        best, place, lang = min(zip(sizes, range(len(sizes)), self.languages))
        others = [s for i, s in enumerate(sizes) if i != place]
        margin = 1 - best / min(others) if others else 1.0
        return lang, margin, margin >= MARGIN


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' rows with lang_pred, score and accepted; all columns of docs stay but those of these names.

    Null texts, texts without a letter, and any text when no language was
    learnt, are 'und' with score 0 and not accepted. Ties between languages go
    to the one with the most labelled texts, then the first by name, with score
    0 and not accepted; one learnt language alone scores 1.
    score is the share by which the best encoding is smaller than the next.
    Very long texts are encoded whole, block by block. Repeated rows are judged
    alike, and an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            found = [encoder.predict(x.as_py()) for x in batch.column(names.index(text_col))]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "lang_pred", "score", "accepted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{fields}, lang_pred string, score double, accepted boolean")
