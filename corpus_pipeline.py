"""From raw documents to packed training sequences, in stages that each read what the stage before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.llm import linecrf, mixing, packing, secretscan, shinglejoin
from priorline.llm.common import Scratch, pin
from priorline.sources.tables import Tables

ORACLE_SQL = None  # the classifier, the forest and the tokenizer are not SQL; tests/llm holds the stages against plain versions


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go.  Null, empty and repeated rows are judged by their own text; an empty table stays empty."""
    pin(spark)
    return linecrf.keep_good(docs, linecrf.fit_quality(docs, Tables(spark, sf_dir).labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays; documents without words stay, repeated rows once."""
    pin(spark)
    return shinglejoin.keep_one(docs, shinglejoin.near_groups(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; no document goes, and null texts stay null."""
    pin(spark)
    found = secretscan.scan_secrets(docs, secretscan.fit_forest(secretscan.labelled_findings(spark)))
    return secretscan.mask_secrets(docs, found).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; repeated rows and null ids are taken apart."""
    pin(spark)
    return mixing.take_copies(docs, mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; a null text is an empty one."""
    pin(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; a stage's input goes when its output is written."""
    scratch, docs, before = Scratch(spark), Tables(spark, sf_dir).documents, None
    for _, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.release(before)
        before = docs
    return docs
