"""Corpus pipeline: quality, near copies, personal data, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each stage as Parquet and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.jaccard_join import jaccard_components
from millrace.llm.mixing import mix
from millrace.llm.packing import pack
from millrace.llm.pii import redact
from millrace.llm.quality_classifier import scored_rows
from millrace.session import ship
from millrace.storage import Workspace

#: Documents that score under this are rejected; shingles and similarity (hundredths) of near copies.
REJECT, WIDTH, PERCENT = 0.5, 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier does not reject; rows without label data are all kept."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return scored_rows(docs, labels).where(F.col("score") >= REJECT).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def _one_each(docs: DataFrame, key: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """One row of each group of near copies, the one with the smallest key, once; and the keys of several rows."""
    found = ws.save(jaccard_components(docs, id_col=key, width=WIDTH, percent=PERCENT, workspace=ws).select(key, "component_id"), "components")
    gone = ws.save(found.where(F.col("component_id") != F.col(key)).select(key).distinct(), "gone")
    twice = ws.save(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    kept = docs.join(gone, key, "left_anti").select(*docs.columns)
    if not twice.limit(1).count():
        return kept, twice
    return kept.join(twice, key, "left_anti").select(*docs.columns).unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key]).select(*docs.columns)), twice


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest id, once. Rows with a null id are kept. Where rows of
    one id have different texts, ids with the text's hash take the place of ids."""
    ws = Workspace(ship(spark), "near-copies")
    kept, twice = _one_each(docs, "doc_id", ws)
    if not twice.limit(1).count():
        return kept
    texts = docs.join(twice, "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("h")).distinct()
    if not texts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return kept
    order = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    key = "key" + "_" * max(map(len, docs.columns))  # longer than any name of the table
    keyed = docs.withColumn(key, F.concat(order, F.coalesce(F.sha2("text", 256), F.lit(""))))
    return _one_each(keyed, key, ws)[0].select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the new text."""
    ship(spark)
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents until sources have their target weights."""
    ship(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut and place documents in windows of tokens."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("source mixing", source_mix),
    ("packing", packing),
]

#: The classifier, the boosted trees and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(ship(spark), "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            ws.drop(before)
        docs = before = after
    return docs
