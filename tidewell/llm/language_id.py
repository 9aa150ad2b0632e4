"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of sample text. A text is cut
into segments, each compressed with every language's dictionary; the language whose
dictionary gives the fewest bytes in total wins. A narrow margin means rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import table

#: Bounds of the sample that the dictionaries are made of, for each language.
SAMPLE_DOCUMENTS = 240
SAMPLE_CHARACTERS = 1500
DICTIONARY_BYTES = 64 << 10
SEGMENT_BYTES = 2048
#: Texts are compared in lower case; matches of four bytes count, which is what tells short texts apart.
LEVEL, MIN_MATCH, STRATEGY = 6, 4, zstandard.STRATEGY_LAZY
#: A prediction is rejected if the second language needs less than this share of bytes more.
NARROW = 0.005
UNKNOWN = "und"


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def dictionaries(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, bytes]:
    """One dictionary per value of `lang`, from at most SAMPLE_DOCUMENTS of its rows.

    The rows are the first by a hash of `key`, so the sample is the same on every run.
    Rows with null lang, text or key aren't used; equal texts count once. Of the samples'
    bytes, one after the other in that order, the last DICTIONARY_BYTES make the dictionary.
    """
    keys = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("key"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = keys.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE_DOCUMENTS).select("key").distinct()
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.substring(F.col(text), 1, SAMPLE_CHARACTERS).alias("sample"))
    # SAMPLE_DOCUMENTS keys a language
    rows = rows.join(F.broadcast(chosen), "key", "left_semi").select("lang", "sample", F.xxhash64("key").alias("order")).distinct()
    samples: dict[str, dict[str, None]] = {}
    for r in sorted((r for r in rows.collect() if r.lang is not None and r.sample), key=lambda r: (r.lang, r.order, r.sample)):
        samples.setdefault(r.lang, {})[r.sample.lower()] = None
    # zstandard finds matches near the end of a dictionary first, so nothing of it is wasted by cutting the front
    return {k: "\n".join(v).encode()[-DICTIONARY_BYTES:] for k, v in samples.items()}


class Classifier:
    """Made once in each task."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, strategy=STRATEGY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for name in self.languages:
            content = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        segments = [data[i : i + SEGMENT_BYTES] for i in range(0, len(data), SEGMENT_BYTES)]
        return [sum(len(c.compress(s)) for s in segments) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the prediction is rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        ranked = sorted(zip(self.sizes(text), self.languages, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        best, second = ranked[0][0], ranked[1][0]
        return ranked[0][1], (second - best) / second, second - best < NARROW * best


_LETTERS = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTERS.finditer(text))


def identified(docs: DataFrame, samples: dict[str, bytes], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected"), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all if None) of `docs` with the prediction for `text` in three more columns.

    A text that is null or has no letter is UNKNOWN with score 0 and rejected. Texts are
    read whole, whatever their length. Columns of `docs` that have one of the three names
    are replaced. Rows are neither moved nor merged, so repeated rows and an empty table
    need no care.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    docs = docs.select(*dict.fromkeys([*keep, text]))
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # a fixed number of bytes for each language

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier.predict(t.as_py()) for t in batch.column(text)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            added = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=[*keep, *names])

    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = dictionaries(docs.where(is_training(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identified(docs.select("doc_id", "text"), samples, keep=["doc_id"])
    return out.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")
