"""The corpus pipeline: graded, deduplicated, decontaminated, masked and mixed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from discoforge.llm import decontaminate, minhash, mix, quality, secrets
from discoforge.llm.common import stash, table


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is high enough; ratings come from labels.

    Null and empty texts and texts of white space go; a chance of just the limit is kept; repeated rows fare alike. Without
    ratings of two grades every text with words stays, and an empty table stays empty.
    """
    return quality.good_ones(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least doc_id.

    Rows count by id and text: rows without an id are compared too and stay only where no row with one does, of
    repeated rows one stays, two texts of an id are two rows. Rows without words all stay. An empty table stays empty.
    """
    return minhash.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whether they have an id or not.

    Null and empty texts stay; repeated rows fare alike; a similarity of just the threshold is a leak. An empty table,
    or an empty benchmark, changes nothing.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced and n_chars counted anew.

    Null and empty texts stay as they are, repeated rows are masked alike, texts of any length are masked whole.
    """
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each row.

    Null and empty texts have size 0 and nothing taken; a null source is a source of its own; quotients that tie go by
    source; repeated rows share their place. An empty table gives an empty result.
    """
    return mix.mix(docs)


#: Name and function of each stage; a function takes (spark, docs, sf_dir).
STAGES = [
    ("quality classifier", grade),
    ("near-duplicates", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("secret masking", mask_secrets),
    ("source mix", mix_sources),
]

#: Regression weights and permutations have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result but the last is written before the next reads it.

    What each stage does with nulls, empty texts, ties and repeated rows stands there; other columns pass through all
    but the last, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stash(docs)
    return docs
