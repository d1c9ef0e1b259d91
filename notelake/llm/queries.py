"""Registered queries of this subpackage; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import language, leaks, mixing, neardup, neighbours, pieces, quality, unify
from notelake.runtime import table


# ------------------------------------------------------------------ 1 oversized items
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pieces.split_chunks(table(spark, sf_dir, "chunks"), longer_than=pieces.LIMIT)
    return split.select("doc_id", "chunk_index", "cut_kind")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.renumbered_pieces(table(spark, sf_dir, "chunks"))


# ------------------------------------------------------------------ 2 visually identical text
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("slug", "concepts", "slug"), ("alias_slug", "concept_aliases", "alias_slug"), ("doc_id", "chunks", "doc_id"))
    parts = [unify.lookalikes(table(spark, sf_dir, t), c).select(F.lit(f).alias("field"), "value_a", "value_b") for f, t, c in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("slug", "concepts", "slug"), ("alias_slug", "concept_aliases", "alias_slug"), ("doc_id", "chunks", "doc_id"))
    parts = [unify.value_forms(table(spark, sf_dir, t), c).select(F.lit(f).alias("field"), "value", "form") for f, t, c in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ 3 most similar vectors
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit(0).alias("kind"), F.when(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull(), F.concat("doc_id", F.lit("#"), "chunk_index")).alias("key"), "embedding")
    concepts = table(spark, sf_dir, "concepts").select(F.lit(1).alias("kind"), F.col("id").cast("string").alias("key"), "embedding")
    return chunks.unionByName(concepts)


def _kind() -> Column:
    return F.when(F.col("kind") == 0, "chunk").otherwise("concept").alias("kind")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, sf_dir)).select(_kind(), "key_a", "key_b")


def p3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.most_similar(_vectors(spark, sf_dir)).select(_kind(), "key", "other", "cosine")


# ------------------------------------------------------------------ 4 near-duplicates
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_keys(table(spark, sf_dir, "chunks"), ["doc_id", "chunk_index"])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(table(spark, sf_dir, "chunks"), ["doc_id", "chunk_index"])


# ------------------------------------------------------------------ 5 languages
def _filters(spark: SparkSession, sf_dir: str) -> language.Filters:
    return language.fitted(table(spark, sf_dir, "chunks"), "content", "language", table(spark, sf_dir, "common_words"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(table(spark, sf_dir, "chunks"), ["doc_id", "chunk_index"], "content", "language", _filters(spark, sf_dir))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments_of(table(spark, sf_dir, "chunks"), ["doc_id", "chunk_index"], "content", _filters(spark, sf_dir))


# ------------------------------------------------------------------ 6 leaked test passages
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


# ------------------------------------------------------------------ 7 source mix
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


# ------------------------------------------------------------------ 8 text statistics
def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), lang="lang")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).filter("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_forms, p3_found, p3_similar, p4_found, p4_groups, p5_found, p5_segments, p6_found, p6_cleaned, p7_found, p7_shares, p7_mix, p8_found, p8_statistics)}
