"""A training corpus from raw documents: five stages, each on what the one
before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet to the shared folder and reads it for the next.  All stages but the
last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linescope.llm import bpe, importance, line_dedup, mixing, ngram_join
from linescope.llm.queries import with_topic
from linescope.llm.storage import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that reach the mix and stay in it.
MIX_SHARE = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return importance.resample(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier one resembles; emptied texts go."""
    return line_dedup.dedup(docs, shortest=1).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.first_of_each_group(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of `MIX_SHARE` of the tokens, whose sources, languages and sizes
    lean to the tempered shares; rare cells are kept whole."""
    return mixing.mix(with_topic(docs), share=MIX_SHARE).filter("kept").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Hashed models, Unicode classes and merges are out of reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
