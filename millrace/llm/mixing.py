"""Mixing sources to target weights (operator 6).

Tokens are aggregated per source, each source's repetition rate follows from its target, and a document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate. The draws are
independent, so what a source gives differs from its target as chance has it: by some percent where a source has
hundreds of documents, by less the more it has.

Edge cases: null or blank text has size 0; a null source is a source of its own and sorts last; a source without
words has target 0 and rate 0; rows of one id draw alike, rows with a null id draw by their text; an empty table gives an
empty result; extra columns, whatever their names, are carried by ``mix`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.storage import Workspace, scratch

#: The weights that sources take in turn, the share of all words that the mix takes, the largest rate.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Seed of the draws.
SEED = 0
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside space and 0x09-0x0D; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0).cast("bigint")).otherwise(F.size(F.split(bare, f"[{SPACE}]+")).cast("bigint"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sharing the total by weight, capping at ``most`` times the source's size and sharing the excess again ends where
    every source has min(cap, level * weight). In order of cap / weight the capped sources come first, so running
    sums find the level at once. One row per source goes through the window.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sums.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)) + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        weighted.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("after", F.sum("w").over(after))
        .withColumn("full", (F.col("total") - F.col("before")) * F.col("w") > F.col("cap") * F.col("after"))
    )
    open_w, full_cap = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(whole), F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    shared = (F.col("total") - full_cap) * F.col("w") / open_w
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", shared)).alias("target"))


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in [0, 1) from 52 bits of a hash of seed and id, or of seed and text where the id is null."""
    own = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _copies(rate: str, draw: Column) -> Column:
    return F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("bigint")


def _rated(sizes: DataFrame) -> DataFrame:
    """``of, source_size, target, rate``: one row per source."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return source_targets(sizes).select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, workspace: Workspace | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, copies, source``. The join carries no hint: a source
    table of small measured size is broadcast, a large one is joined by a sort whose hot keys adaptive execution splits."""
    ws = scratch(docs.sparkSession, "mix", workspace)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _draw(F.col(id_col), F.col(text_col), seed).alias("draw"))
    sizes = ws.save(sizes, "sizes")
    rates = ws.save(_rated(sizes), "rates")
    rated = sizes.join(rates, F.col("source").eqNullSafe(F.col("of")))
    return rated.select("doc_id", "size", "source_size", "target", _copies("rate", F.col("draw")).cast("bigint").alias("copies"), "source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, workspace: Workspace | None = None) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as many times as the plan takes it; all columns are kept."""
    ws = scratch(docs.sparkSession, "mix", workspace)
    rates = ws.save(_rated(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))), "rates")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(source_col).alias("source"), _draw(F.col(id_col), F.col(text_col), seed).alias("draw"))
    taken = rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("n", _copies("rate", F.col("draw"))).where("n > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = rf"""
WITH sizes AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS own, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, source_size * {MOST}::DOUBLE AS cap, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w FROM s),
p AS (SELECT *, sum(source_size) OVER () * {SHARE}::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM w),
f AS (SELECT *, (total - before) * w > cap * after AS is_full FROM p),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS target FROM f),
r AS (SELECT z.doc_id, z.size, z.own, t.*, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (('0x' || substr(md5('{SEED}:' || own), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) AS taken FROM r
"""
