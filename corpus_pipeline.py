"""Corpus preparation as stages over `documents`: quality rules, language, near-duplicates, secrets, packing.

Each stage reads the documents that its predecessor kept, and its decisions take effect: lines above limits and failing
documents go; texts without a clear language go and `lang` becomes the predicted one; one document of each near-duplicate
group stays; secrets are replaced by a mark; the last stage gives the places of the documents in training sequences.
`n_chars` follows the text.

All stages take any columns that documents may have besides these and leave them out. Null and empty texts fail the quality rules, so that the later
stages meet none in run(); alone, they reject them as without language, link them as equal, leave them, and pack an end token. Rows of one id
are judged alike, and one of them stays among near-duplicates; rows without id are kept apart. Ties go to the smallest id, or the first language by name. Very long texts are handled whole. An
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, packing, quality, secrets, simhash
from tessera.llm.common import ship_code, stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: documents that pass, without lines above limits; each keeps at least one text of any group of copies."""
    ship_code(spark)
    return _documents(quality.apply_quality_rules(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: documents with a clear language, learned from the labelled ones here."""
    ship_code(spark)
    return _documents(langid.identified(docs, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: one document of each group linked by five-word shingles with similarity 0.8 or more."""
    ship_code(spark)
    return _documents(simhash.keep_one(docs, shingle=5))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: every document, with its secrets replaced."""
    ship_code(spark)
    return _documents(secrets.without_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: places of all documents in training sequences."""
    ship_code(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("packing", pack)]
#: The stages' hashes, compressors and tokenizers are outside SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
