"""Mixing sources to target weights: capped water-filling, then a seeded sample of whole and
fractional repetitions.  Native: DataFrame functions only.

* Targets.  Sources in code-point order (null last) carry the weights 1, 2, 3, 1, 2, ...  They share
  ``budget`` words (default: all of them) in proportion; a source stops at ``max_epochs`` times its
  own size and what it can't take goes to the others by weight, until nobody is above.  Every round
  is one distributed aggregate; only scalars (sums) reach the driver.
* Sample.  A source repeats each of its documents ``floor(epochs)`` times; the fraction that is left
  goes to the documents that come first in the order of a seeded digest of their id.  The order is
  cut by a histogram of the digest's first hex digits per source, so that a source with a third of
  all rows is never sorted in one task: only the one cell that the cut falls into is.

Defined cases: null text has size 0; null source is a source of its own, last in order; repeated
rows are separate rows; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

MAX_EPOCHS = 3
CELL_HEX = 3  # 16 ** 3 histogram cells a source
WORD = r"[^\x20\x09-\x0D]+"


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) in order of ``source``, null last, by a distributed sort: position in
    the sorted partition plus the sizes of the partitions before it."""
    spark = sources.sparkSession
    listed = materialize(
        sources.orderBy(F.col("source").asc_nulls_last())
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33)),
        "mix-sources",
    )
    parts = listed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    del spark
    return listed.join(F.broadcast(before), "_part").select(
        *sources.columns, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("rank")
    )


def water_fill(sources: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` has source, source_size and an integer weight; adds ``target``.

    Rounds of clamping: sources whose share reaches their cap stop there, the rest share what is
    left.  A round's state is two sums, so no list of sources is held by the driver.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total, caps = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(cap), F.lit(0))).first()
    left = min(total if budget is None else budget, caps)
    budget, clamped, weights = left, None, None
    while True:
        # share of an open source: left * weight / weights
        is_open = F.lit(True) if clamped is None else cap * F.lit(weights) > F.lit(left) * F.col("weight")
        open_w, shut = sources.agg(
            F.coalesce(F.sum(F.when(is_open, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_open, cap)), F.lit(0)),
        ).first()
        if (open_w, shut) == (weights, clamped):
            break
        weights, clamped, left = open_w, shut, budget - shut
        if not weights:
            break
    share = (F.lit(float(left)) * F.col("weight") / F.lit(float(weights))) if weights else F.lit(0.0)
    full = cap * F.lit(weights or 0) <= F.lit(left) * F.col("weight")
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(share.cast("double")))


def mix_sources(docs: DataFrame, seed: str = "mix", max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        "mix-sized",
    )
    cells = materialize(
        sized.groupBy("source", F.substring("_order", 1, CELL_HEX).alias("_cell")).agg(F.sum("size").alias("_cell_size")),
        "mix-cells",
    )
    sources = cells.groupBy("source").agg(F.sum("_cell_size").alias("source_size"))
    weighted = ranked_sources(sources).withColumn("weight", (F.col("rank") % 3 + 1).cast("long"))
    targets = water_fill(materialize(weighted, "mix-weights"), budget, max_epochs).select(
        "source", "source_size", "target"
    )
    epochs = targets.withColumn(
        "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn(
        # words still to be taken after the whole repetitions
        "_rest", F.round(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size")
    )
    # at most 16 ** CELL_HEX rows for a source: the window is bounded
    running = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = materialize(
        cells.join(epochs, cells["source"].eqNullSafe(epochs["source"]))
        .drop(epochs["source"])
        .withColumn("_before", F.sum("_cell_size").over(running) - F.col("_cell_size")),
        "mix-plan",
    ).select(
        F.col("source").alias("_source"), F.col("_cell").alias("_in"), "_before", "_cell_size", "source_size", "target", "_whole", "_rest"
    )
    rows = sized.join(
        plan, sized["source"].eqNullSafe(plan["_source"]) & (F.substring(sized["_order"], 1, CELL_HEX) == plan["_in"])
    )
    cut = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_cell_size") > F.col("_rest"))
    base = ["doc_id", "source", "size", "source_size", "target"]
    easy = rows.where(~cut).select(
        *base, (F.col("_whole") * F.col("size") + F.when(F.col("_before") < F.col("_rest"), F.col("size")).otherwise(0)).alias("taken")
    )
    inside = Window.partitionBy("source").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hard = rows.where(cut).withColumn("_seen", F.col("_before") + F.sum("size").over(inside) - F.col("size"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_seen")))
    return easy.unionByName(hard.select(*base, (F.col("_whole") * F.col("size") + part).cast("long").alias("taken")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same by closed form: sources by cap per weight; the first k that make the rest feasible stop at their caps.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM {docs}
), srcs AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k
  FROM srcs
), level AS (
  SELECT (total - capped)::DOUBLE AS left_over, open_w::DOUBLE AS open_w FROM filled
  WHERE (total - capped) * weight < 3 * source_size * open_w ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size * coalesce((SELECT open_w FROM level), 0) <= coalesce((SELECT left_over FROM level), 0) * weight
              THEN (3 * source_size)::DOUBLE
              ELSE (SELECT left_over FROM level) * weight / (SELECT open_w FROM level) END AS target
  FROM filled
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), mixed AS (
  SELECT s.doc_id, s.source, s.size, e.source_size, e.target,
         (e.whole * s.size + least(s.size, greatest(0, round(e.target)::BIGINT - e.whole * e.source_size
           - (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size))))::BIGINT AS taken
  FROM sized s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
)"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {
    "op2_mixing": "WITH " + MIX_SQL.format(text="text", docs="documents").lstrip() + " SELECT doc_id, size, source_size, target, taken FROM mixed"
}
