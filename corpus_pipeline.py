"""Training sequences from the table documents: each stage works on all that the one before it has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterwise.llm.common import dropped, kept_tables, stored, table, temporary
from meterwise.llm.exact_dedup import exact_dedup
from meterwise.llm.minhash_dedup import near_dedup
from meterwise.llm.packing import best_fit_packing
from meterwise.llm.pii import pseudonymised, session_key
from meterwise.llm.toxicity import labelled_chain, without

#: Words that a Python worker of the last stage remembers, in bytes; the workers of the other stages live beside it.
CACHE = 32 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. It is trained on the labelled ones among them."""
    return without(docs, labelled_chain(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_dedup(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms under the secret of the setting spark.meterwise.secret.key, or one of this session."""
    return pseudonymised(docs, session_key(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, packed into sequences of 1024: a row for each piece, with its ids and its place."""
    import public_tokenizers  # here, as queries that need no vocabulary must be found without it

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024, with_ids=True, cache_bytes=CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii", pii),
    ("packing", packing),
]
#: SQL expresses neither the trained classifier nor MinHash, Feistel pseudonyms and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written and reread. Null and empty texts go through as empty ones, of
    which exact dedup leaves one; texts of any length are worked on whole; of an empty table nothing is left."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        with temporary(spark):  # a stage's own tables go when its result is written, and so does what it worked on
            result, before = stage(spark, docs, sf_dir), docs
            with kept_tables():
                docs = stored(result, f"stage-{name}")
        if n:
            dropped(before)
    return docs
