"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import embedding_join, fill_in_middle, jaccard_join, language_id, mixing, packing, phrases, pii, quality_classifier, quality_rules, quote_links, sql, substring_dedup, url_filter

def quote_links_on_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over the same messages with quotes put in, as the table holds none."""
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("millrace_conversations")
    made = sql.ANSWERS.replace("FROM conversations", "FROM millrace_conversations").replace("chr(10)", "char(10)")
    return quote_links.reply_order(spark.sql(made))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2's columns that follow from the rules alone."""
    found = url_filter.op2(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's columns of base spans."""
    return pii.op5(spark, sf_dir).drop("spans")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's counts and base rules."""
    return quality_rules.op7(spark, sf_dir).drop("char_distance", "word_distance", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": embedding_join.op1,
    "op2_url_templates": url_filter.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_quote_links": quote_links.op4,
    "op5_pii_spans": pii.op5,
    "op6_source_mixing": mixing.op6,
    "op7_quality_divergence": quality_rules.op7,
    "op8_quality_classifier": quality_classifier.op8,
    "op9_packing": packing.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_language_id": language_id.op11,
    "op12_phrases": phrases.op12,
    "op13_fill_in_middle": fill_in_middle.op13,
    "quote_links_on_answers": quote_links_on_answers,
    "url_rules": url_rules,
    "pii_base": pii_base,
    "quality_counts": quality_counts,
}

#: Operators 8, 9 and 11 have no SQL (a trained network, a tokenizer, a compressor); of 2, 5 and 7 it covers what no model decides.
SQL: dict[str, str] = {
    "op1_embedding_near_dedup": sql.OP1,
    "op3_jaccard_join": sql.OP3,
    "op4_quote_links": sql.OP4,
    "quote_links_on_answers": sql.quote_links(sql.ANSWERS),
    "op6_source_mixing": mixing.OP6_SQL,
    "op10_substring_dedup": sql.OP10,
    "op12_phrases": phrases.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    "url_rules": sql.URL_RULES,
    "pii_base": sql.PII_BASE,
    "quality_counts": sql.QUALITY_COUNTS,
}
