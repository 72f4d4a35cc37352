"""Corpus pipeline over ``documents``: each stage's rows are written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremorlake.llm import common, langid, mixing, ngram_join, packing, secrets

#: Documents whose best language is less likely than this many times chance, or than the most asked, are rejected, as are those without a letter.
CHANCE_TIMES, MOST_ASKED = 1.4, 0.5
#: Names of the columns that the first stage adds and takes away; no table's own.
LANGUAGE, LIKELY = "__pipeline_language", "__pipeline_likely"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the network knows; it learns from the documents' own labels.

    Null text and text without a letter go; null labels teach nothing; repeated rows stay or go together; without any
    label only letters decide; an empty table gives no rows. Columns stay, whatever their names.
    """
    languages, network = langid.train(docs)
    if network is None:  # nothing to learn from: only letters decide
        return docs.where(docs["text"].rlike(r"\p{L}"))
    labelled = langid.predict(docs, languages, network, docs.columns, (LANGUAGE, LIKELY))
    asked = min(MOST_ASKED, CHANCE_TIMES / len(languages))
    return labelled.where((labelled[LANGUAGE] != langid.UNKNOWN) & (labelled[LIKELY] >= asked)).drop(LANGUAGE, LIKELY)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that near duplicates form: that of the least id.

    Rows without an id and rows without words stay; of repeated rows one stays; an empty table gives no rows. Columns stay.
    """
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in texts; ``n_chars`` follows the text. Null and clean texts, repeated rows and all other columns stay."""
    return secrets.redact(docs, length="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as its source's target asks; null sources are one source, repeated rows are taken alike. Columns stay."""
    return mixing.take_mix(docs, mixing.cycle_1_2_3())


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences, a row per piece; null text is the end id alone, every copy is packed."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the trained network and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
