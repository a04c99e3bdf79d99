"""The pipeline's operators as registered queries over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import archives, bpe, collocations, counts, jaccard, lexical, licences, mixing, multiindex, neighbours, quality, repeats, rules
from lorekeep.llm.tables import own, table
from lorekeep.session import checkpoint_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    return archives.pages_through_archives(spark, table(spark, sf_dir, "pages"), folder)


def shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.linked_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs.select(*own(docs, "doc_id", "text")), BYTE_BPE)


def radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.verdicts(docs, labels)


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences_found(table(spark, sf_dir, "documents"))


def section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.section_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.linked_vectors(table(spark, sf_dir, "embeddings"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_arc_to_warc": arc_to_warc,
    "op2_shingle_join": shingle_join,
    "op3_byte_bpe": byte_bpe,
    "op4_radix_dedup": radix_dedup,
    "op5_quality_rules": quality_rules,
    "op6_licence_scan": licence_scan,
    "op7_section_token_counts": section_token_counts,
    "op8_quality_classifier": quality_classifier,
    "op9_source_mix": source_mix,
    "op10_learned_partitions": learned_partitions,
    "op11_multi_index": multi_index,
    "op12_ranked_search": ranked_search,
    "op13_phrase_mining": phrase_mining,
}
