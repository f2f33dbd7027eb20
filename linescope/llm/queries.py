"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.llm import bpe, chat, hamming, importance, licenses, line_dedup, merkle, mixing, ngram_join, quality_rules, toxicity, web_pages, whitening
from linescope.llm.storage import table

#: Share of the corpus's tokens that the mix keeps.
MIX_SHARE = 0.5

_ODD_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _ODD_TEXT), (-7, 1, "assistant", _ODD_TEXT)], turns.schema)
    return chat.read_chat(chat.format_chat(turns.union(more)))


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, rows.filter("id % 20 = 0"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_topic(table(spark, sf_dir, "documents"))
    rows = mixing.mix(docs.select("doc_id", "source", "lang", "topic", "n_tokens"), share=MIX_SHARE)
    return rows.withColumn("probability", F.round("probability", 9))


def with_topic(docs: DataFrame) -> DataFrame:
    """The tables name no topic; a document's size stands for it."""
    docs = docs.withColumn("n_tokens", mixing.n_tokens())
    return docs.withColumn("topic", mixing.size_topic(F.col("n_tokens")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_pages.extract(table(spark, sf_dir, "pages"))


#: The tables name no files: paths are made from source, language and doc_id.
#: Texts that name a licence are licence files, most of a directory that holds
#: others; every 29th text begins with a header.
_PATHS = """
select doc_id,
  concat(source, '/', lang, '/', case when text like '%icense%' and doc_id % 3 > 0 then 'LICENSE'
         when text like '%icense%' then concat('d', cast(doc_id % 97 as varchar(20)), '/COPYING.txt')
         else concat('d', cast(doc_id % 97 as varchar(20)), '/f', cast(doc_id as varchar(20)), '.txt') end) as path,
  case when doc_id % 29 = 3 then concat('// This Source Code Form is subject to the terms of the Mozilla Public', chr(10),
         '// License, v. 2.0. If a copy of the MPL was not distributed with this', chr(10),
         '// file, You can obtain one at http://mozilla.org/MPL/2.0/.', chr(10), text)
       when doc_id % 29 = 4 then concat('/*', chr(10), ' * Permission to use, copy, modify, and/or distribute this software for any', chr(10),
         ' * purpose with or without fee is hereby granted, provided that the above', chr(10),
         ' * copyright notice and this permission notice appear in all copies.', chr(10), ' */', chr(10), text)
       else text end as text
from documents
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.sql(_PATHS.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.verdicts(table(spark, sf_dir, "documents"), shortest=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"), share=0.0, per_document=True)
    return rows.drop("removed_lines", "host")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.document_leaves(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_hamming_top_k,
        op3_mix_sources,
        op4_byte_bpe,
        op5_ngram_join,
        op6_html_extract,
        op7_license_scan,
        op8_quality_classifier,
        op9_line_dedup,
        op10_quality_rules,
        op11_merkle_manifest,
        op12_embedding_whitening,
        op13_toxicity,
    )
}

_MIX, _MIXED = mixing.mix_sql(share=MIX_SHARE)

ORACLES: dict[str, str] = {
    "op2_hamming_top_k": """
with codes as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as bits from embeddings where embedding is not null),
pairs as (select q.vec_id as query_id, d.vec_id as neighbor_id,
                 cast(list_sum(list_transform(range(1, 65), lambda k: abs(q.bits[k] - d.bits[k]))) as integer) as distance
          from codes q cross join codes d where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by distance, neighbor_id) as integer) as rank, neighbor_id, distance
from pairs qualify row_number() over (partition by query_id order by distance, neighbor_id) <= 10""",
    "op11_merkle_manifest": merkle.manifest_sql(),
    "op7_license_scan": licenses.scan_sql(_PATHS),
    "op3_mix_sources": f"with {_MIX} select doc_id, source, lang, topic, n_tokens, round(probability, 9) as probability, kept from {_MIXED}",
}
