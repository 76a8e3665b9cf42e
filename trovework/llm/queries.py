"""The queries of this package, each over its whole tables; and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovework.llm import credentials, encoding, mixing, offence, prose, provenance, splitting, structure
from trovework.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rest of a key that a chunk before begins is none of its own: the key's line is that of its first marker
    return credentials.find_credentials(table(spark, sf_dir, "code_chunks_vectors")).where(F.col("kind") != credentials.PART).select("id", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redact_credentials(table(spark, sf_dir, "code_chunks_vectors"))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, sf_dir, "code_chunks_vectors"), table(spark, sf_dir, "search_results"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_reasons(spark, sf_dir).select("source_file")


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "code_chunks_vectors")
    return prose.find_prose(chunks, prose.fit(spark, table(spark, sf_dir, "documents"), chunks))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).select("id", "line_no", "prose_lang").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.shares(table(spark, sf_dir, "code_chunks_vectors"), _prose(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.member_starts(table(spark, sf_dir, "code_chunks_vectors")).where("line_no > 1").select("id", F.col("line_no").cast("int"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "code_chunks_vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.functions_with_docs(table(spark, sf_dir, "code_chunks_vectors"), table(spark, sf_dir, "search_results")).select("id", "func_name").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pairs(table(spark, sf_dir, "code_chunks_vectors"), table(spark, sf_dir, "search_results"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.decode(p6_ids(spark, sf_dir)).select("doc_id", "text")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= offence.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.rates(p8_scores(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        # the round trip gives the texts again, "" for null
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
