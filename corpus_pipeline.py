"""A corpus for training, from `documents`: language, boilerplate lines, near duplicates,
personal data, and packing into windows, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All
but the last return the columns of `docs`, whatever these are. Rows with null or repeated
doc_id are documents like others. Null and empty texts have no language and go in the first
stage. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language_id, line_dedup, packing, personal_data, shingle_join
from tidewell.llm.common import table, written

#: Shingles of this many words tell near duplicates here.
NEAR_DUPLICATE_WORDS = 5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with `lang` as it was; the labels of `docs` itself train the classifier."""
    samples = language_id.dictionaries(docs.where(language_id.is_training(F.col("doc_id"))).select("doc_id", "text", "lang"))
    names = ("_lang_pred", "_lang_score", "_lang_rejected")
    return language_id.identified(docs, samples, names=names).where("not _lang_rejected").drop(*names)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sources share; n_chars follows the text."""
    return _recounted(line_dedup.cleaned(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, null after all others. Of rows with one doc_id and one text, one stays."""
    keyed = docs.withColumn("_own_key", F.xxhash64("doc_id", "text"))
    found = shingle_join.classes(keyed, key="_own_key", size=NEAR_DUPLICATE_WORDS, percent=80).select(F.col("_doc").alias("_own_key"), "component")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_own_key"))["_own_key"]
    kept = keyed.select("_own_key", "doc_id").distinct().join(found.distinct(), "_own_key").groupBy("component").agg(first.alias("_own_key")).select("_own_key")
    return keyed.join(kept, "_own_key", "left_semi").dropDuplicates(["_own_key"]).drop("_own_key")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    return _recounted(personal_data.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie."""
    return packing.packed(docs)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", keep_identified),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Not expressible in SQL: compression, tokenization and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
