"""Queries of the training-data tasks, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import abuse, encoding, mixing, similar_vectors


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.nearest_pairs(_table(spark, d, "vector_blocks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(_table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, d), _table(spark, d, "mix_targets"))


def p7_capped(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix of a thousand million tokens, which no source of a few documents can fill."""
    documents, targets = _table(spark, d, "documents"), _table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(documents, targets, total_tokens=1_000_000_000), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found_documents(_table(spark, d, "documents"), _table(spark, d, "doc_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(_table(spark, d, "documents"), _table(spark, d, "doc_labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_report": p7_report, "p7_capped": p7_capped, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """with usable as (
  select (row_ids_high & 4294967295) * 4294967296 + (row_ids_low & 4294967295) as id, dimensions, vectors::double[] as v from vector_blocks
  where coalesce(valid, true) and len(vectors) = dimensions and len(list_filter(vectors, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vectors, lambda x: x <> 0)) > 0),
vecs as (select id, any_value(dimensions) as dimensions, any_value(v) as v from usable group by id),
ranked as (
  select a.id as a, b.id as b, row_number() over (partition by a.id order by round(list_cosine_similarity(a.v, b.v), 9) desc, b.id) as place
  from vecs a join vecs b on a.dimensions = b.dimensions and a.id <> b.id)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from ranked where place <= 5""",
    }
