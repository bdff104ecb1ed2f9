"""The registered queries of the training-data problems. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leaks, mixing, near_duplicates, overlaps, personal, quotas, similar_vectors, top_items
from graphloom.llm.sql import SQL  # noqa: F401 - part of this module's interface
from graphloom.session import materialise, table


def _near(spark: SparkSession, d: str):
    return near_duplicates.near_duplicates(table(spark, d, "jsonl_records"), "record_id", "summary_en", "written_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs_of_records(*_near(spark, d)).toDF("record_id_a", "record_id_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.classes(*_near(spark, d)).withColumnRenamed("id", "record_id")


def _overlaps(spark: SparkSession, d: str):
    return overlaps.split_overlaps(table(spark, d, "pair_samples"), table(spark, d, "graph_nodes"), table(spark, d, "graph_datasets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_pairs(*_overlaps(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(*_overlaps(spark, d))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_coverage(*_overlaps(spark, d))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_members(*_overlaps(spark, d))[0]


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: samples with an id divisible by 100, against all."""
    n = similar_vectors.asked_neighbours(table(spark, d, "pair_samples"), "sample_id", "vector")
    return n.select(F.col("id").alias("sample_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = similar_vectors.Forest()  # only pairs of at least p.cosine
    members, links = similar_vectors.neighbours(table(spark, d, "pair_samples"), "sample_id", "vector", p)
    n = similar_vectors.nearest(members, similar_vectors.both_ways(links), p.k)
    return n.select(F.least("id", "neighbour").alias("sample_id_a"), F.greatest("id", "neighbour").alias("sample_id_b")).distinct()


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    rows = top_items.scored_candidates(table(spark, d, "similar_pairs"))
    return top_items.top_items(rows, ["target_sample_id"], [F.col("similarity").desc(), F.col("ref_pair_id")], 10)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_top(spark, d).select("target_sample_id", "ref_pair_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = quotas.shortfalls(table(spark, d, "jsonl_records"), table(spark, d, "sample_targets"))
    return spark.createDataFrame([r[:2] for r in rows], "dataset string, difficulty string")


def _quota(spark: SparkSession, d: str):
    return quotas.quota_sample(table(spark, d, "jsonl_records"), table(spark, d, "sample_targets"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d)[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d)[1]


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).where(F.col("longest_run") >= 12).select("item_id", "doc_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p6_leaks(spark, d), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = mixing.plan(mixing.token_counts(table(spark, d, "documents")), table(spark, d, "source_targets"))
    return spark.createDataFrame([(r["name"],) for r in rows if r["missing"] > 0], "source string")


def _mix(spark: SparkSession, d: str):
    return mixing.mix(materialise(mixing.token_counts(table(spark, d, "documents"))), table(spark, d, "source_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_spans(table(spark, d, "documents"), table(spark, d, "name_parts"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "kind", "found_text").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"), table(spark, d, "name_parts"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_report, p2_coverage, p2_members, p3_found, p3_neighbours, p4_found, p4_top, p5_found, p5_sample, p5_report, p6_found, p6_leaks, p6_report, p7_found, p7_mix, p7_report, p8_found, p8_spans, p8_redacted)
}
