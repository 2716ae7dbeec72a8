"""From raw documents to token ids: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on every document that the one before it kept and returns documents with
the same columns; the last returns one row of tokens per document. Stages that remove documents give back the
others untouched; the secret stage keeps every document and masks spans of its text.

Defined results, for each stage and the whole: a null or empty text is judged as empty (scored by the classifier, one
group of empty fingerprints, no passages, no secrets, no tokens); texts of any length are handled whole; rows that
repeat are judged alike, and of a near-duplicate group the row with the smallest id stays, ties going to the first by all
columns; null ids are kept as they are; an empty table gives an empty result; the stages read the columns they name
and hand on all others, whatever they are called.
"""

from pyspark.sql import DataFrame, SparkSession

from gavel.llm import bpe, decontaminate, quality, secrets, simhash
from gavel.llm.common import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.training(table(spark, sf_dir, "labels")))


def first_of_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages beyond the contamination rule."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document."""
    return bpe.tokenize(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", first_of_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", masked_secrets),
    ("byte-level BPE", token_ids),
]

#: Suffix arrays, SimHash, the classifier and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
