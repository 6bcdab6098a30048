"""A corpus pipeline of five operators: documents in, a mixed training set out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a frame that
the runner writes as Parquet and rereads as the next one's ``docs``.  All but the last return the columns of
``documents``; the last one returns the mix.

Scratch tables of a stage are dropped when the next one starts, as its result has been written by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm import common
from docgrid.llm.decontam import contamination
from docgrid.llm.langid import predict, train
from docgrid.llm.line_dedup import dedup_lines
from docgrid.llm.mixing import mix_sources
from docgrid.llm.ngram_join import linked, nodes


def _fresh(name: str) -> str:
    """Scope of a stage's scratch tables; those of the stages before are no longer read."""
    for k, _ in STAGES:
        if k != name:
            common.release(f"pipeline-{k}")
    return f"pipeline-{name}"


def _packed(docs: DataFrame) -> Column:
    """All columns as one, so that no name clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (null text, no letter) go; the others stay as they are."""
    with common.scope(_fresh("language")):
        common.small_batches(spark)
        packed, text = docs.select(_packed(docs)), "_row.text"
        if dict(docs.dtypes)["text"] != "string":
            packed, text = docs.select(_packed(docs), F.col("text").cast("string").alias("_text")), "_text"
        return predict(packed, train(docs), text).where("lang_pred <> 'und'").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or are one edit from it, go; n_chars follows the text.  A document of which
    nothing is left goes."""
    with common.scope(_fresh("lines")):
        found = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.length(F.trim("_row.text")) > 0)).select("_row.*")
        return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays.  Rows of one doc_id, null ones too,
    are documents by their texts: only those that are copies go."""
    with common.scope(_fresh("near_copies")):
        keyed = nodes(docs.select(_packed(docs), common.id_col().alias("id"), F.col("text").cast("string").alias("text")))
        found = linked(keyed.select("doc", "text")).withColumn("id", F.col("doc"))
        told = keyed.where("doc <> id").select("doc", F.col("id").alias("told")).distinct()
        found = found.join(told, "doc", "left").select("doc", "comp", F.coalesce("told", "id").alias("id"))
        found = common.materialize(found, "pipeline-linked")
        first = found.groupBy("comp").agg(F.min(F.struct("id", "doc")).alias("first"))
        copies = found.join(first, "comp").where("doc <> first.doc").select(F.col("doc").alias("_doc")).distinct()
        copies = common.materialize(copies, "pipeline-copies")
        keyed = keyed.select("_row", F.col("doc").alias("_doc"))
        slots = copies.select(F.pmod(F.xxhash64("_doc"), F.lit(common.SLOTS)).alias("_slot")).distinct()
        keyed = keyed.withColumn("_slot", F.pmod(F.xxhash64("_doc"), F.lit(common.SLOTS)))
        # only documents whose slot has a copy have to meet the list
        clean = keyed.join(F.broadcast(slots), "_slot", "left_anti")
        other = keyed.join(F.broadcast(slots), "_slot", "left_semi").join(copies, "_doc", "left_anti")
        return clean.select("_row.*").unionByName(other.select("_row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    with common.scope(_fresh("decontaminate")):
        found = contamination(docs, common.read(spark, sf_dir, "benchmark"), carry=True)
        return found.where("not contaminated").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    with common.scope(_fresh("mix")):
        return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix)]

#: Trained models, edit distances and set joins of whole tables have no SQL twin: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and reread."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with common.scope(f"pipeline-out-{name}"):
            docs = common.materialize(out, "pipeline-out")
        if before:
            common.release(f"pipeline-out-{before}")
        before = name
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
