"""Entities of documents, and what expressions such as "the said amount" refer to."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.numeric import strip
from ..functions.vocabulary import ENTITIES, GENERIC_REFERENCE, REFERENCE_RULES, REFERENCES, UNICODE


def block_text(type_: Column, text: Column, data: Column, alt: Column | None = None, markdown: Column | None = None) -> Column:
    """Plain text of a block: table rows parted by bars, cells by blanks."""
    md = markdown if markdown is not None else F.lit("")
    rows = F.array_join(F.transform(data, lambda r: F.array_join(r, " ")), " | ")
    table = F.when(F.coalesce(F.size(data), F.lit(0)) > 0, rows).otherwise(md)
    image = F.coalesce(alt, F.lit("")) if alt is not None else F.lit("")
    return F.coalesce(F.when(type_ == "table", table).when(type_ == "image", image).otherwise(F.coalesce(text, md)), F.lit(""))


_FOUND = ArrayType(StructType([StructField("category", StringType()), StructField("text", StringType()), StructField("at", IntegerType())]))


@F.pandas_udf(_FOUND)
def _scan(texts: pd.Series) -> pd.Series:
    """Matches with offsets, which the built-in extraction doesn't tell."""
    patterns = [(c, re.compile(p)) for c, p in ENTITIES]
    return texts.map(lambda t: [{"category": c, "text": x, "at": m.start()} for c, p in patterns for m in p.finditer(t or "") if len(x := m[1].strip()) >= 2])


def entity_mentions(blocks: DataFrame) -> DataFrame:
    """Without offsets, in built-in functions: doc_id, pos, category, ord (of the match in the block), text."""

    def matches(rank: int, category: str, pattern: str) -> Column:
        named = lambda x, i: F.struct(F.lit(category).alias("category"), F.lit(rank).alias("rank"), i.alias("ord"), strip(x).alias("text"))
        return F.transform(F.regexp_extract_all("text", F.lit(UNICODE + pattern), F.lit(1)), named)

    arrays = [matches(k, *entity) for k, entity in enumerate(ENTITIES)]
    told = blocks.select("doc_id", "pos", "page_idx", F.explode(F.concat(*arrays)).alias("e")).select("doc_id", "pos", "page_idx", "e.*")
    return told.where(F.length("text") >= 2)


def entity_registry(blocks: DataFrame) -> DataFrame:
    """The first mention of each entity of a document and category, numbered in order: doc_id, category, text, pos,
    page_idx, ord."""
    first = Window.partitionBy("doc_id", "category", "text").orderBy("pos", "ord")
    kept = entity_mentions(blocks).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    by = Window.partitionBy("doc_id", "category").orderBy("pos", "ord")
    return kept.withColumn("ord", F.row_number().over(by) - 1).select("doc_id", "category", "text", "pos", "page_idx", "ord")


def with_context(blocks: DataFrame, window: int = 80) -> DataFrame:
    """All mentions with offsets and the text around them."""
    told = blocks.select("doc_id", "pos", "page_idx", F.col("text").alias("whole"), F.explode(_scan("text")).alias("e"))
    start = F.greatest(F.col("e.at") - window, F.lit(0))
    return told.select("doc_id", "pos", "page_idx", "e.category", "e.text", "e.at", F.substring("whole", start + 1, F.col("e.at") + window - start).alias("context"))


@F.pandas_udf(ArrayType(StructType([StructField("reference", StringType()), StructField("at", IntegerType())])))
def find_references(texts: pd.Series) -> pd.Series:
    """Expressions by offset; of those that begin at one place, the first pattern's."""
    patterns = [re.compile(p) for p in REFERENCES]

    def scan(text: str | None) -> list[dict]:
        found: dict[int, str] = {}
        for p in patterns:
            for m in p.finditer(text or ""):
                found.setdefault(m.start(), m[0])
        return [{"reference": found[k], "at": k} for k in sorted(found)]

    return texts.map(scan)


def reference_rule(reference: Column) -> Column:
    """category and confidence of an expression; null if no rule has it."""
    out = F.lit(None).cast("struct<category: string, confidence: double>")
    for category, sure, words in reversed(REFERENCE_RULES):
        out = F.when(reference.rlike("|".join(words)), F.struct(F.lit(category).alias("category"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def resolve_references(blocks: DataFrame, registry: DataFrame | None = None, window: int = 120) -> DataFrame:
    """doc_id, pos, page_idx, at, reference, resolved_entity, confidence, method, context_snippet.

    Candidates are the entities of the category that the rule names, else all of the document.  The nearest one
    is the one named last in the context; only if none is named there, the most similar one.  References and
    entities meet by document in a join that names no candidate twice; the scores are taken per row.
    """
    registry = entity_registry(blocks) if registry is None else registry
    refs = blocks.select("doc_id", "pos", "page_idx", F.col("text").alias("whole"), F.explode(find_references("text")).alias("r"))
    start = F.greatest(F.col("r.at") - window, F.lit(0))
    refs = refs.select("doc_id", "pos", "page_idx", "r.*", F.substring("whole", start + 1, F.col("r.at") + window - start).alias("context"))
    rank = F.create_map(*[x for i, (c, _) in enumerate(ENTITIES) for x in (F.lit(c), F.lit(i))])
    # categories in the order of their first mention, as a registry that is filled block by block has them
    seen = F.min(F.struct("pos", rank[F.col("category")])).over(Window.partitionBy("doc_id", "category"))
    told = registry.withColumn("first", seen).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "ord", "category", "text"))).alias("known"))
    # shuffled whatever size Spark expects: that of the file, not of the entities in its texts, which a broadcast gathers on the driver
    joined = refs.join(told.hint("merge"), "doc_id", "left").withColumn("rule", reference_rule(F.col("reference")))
    of_kind = F.filter(F.coalesce("known", F.array().cast(told.schema["known"].dataType)), lambda e: e["category"] == F.col("rule.category"))
    names = lambda c: F.transform(c, lambda e: e["text"])
    by_rule = F.coalesce(F.size(of_kind) > 0, F.lit(False))
    joined = joined.withColumn("by_rule", by_rule).withColumn("names", F.when(by_rule, names(of_kind)).otherwise(names(F.col("known"))))
    # the place of the last mention, from the end of the context; the first of equals wins
    spot = lambda e: F.length("context") - F.instr(F.reverse(F.col("context")), F.reverse(e)) - F.length(e) + 1
    named = F.transform(F.filter("names", lambda e: F.contains(F.col("context"), e)), lambda e, i: F.struct(spot(e).alias("at"), (-i).alias("i"), e.alias("e")))
    joined = joined.withColumn("inside", F.array_max(named)["e"])
    near = joined.withColumn("best", F.coalesce("inside", _most_similar(F.when(F.col("inside").isNull(), F.col("context")), F.when(F.col("inside").isNull(), F.col("names")))))
    has = F.col("best").isNotNull()
    return near.select(
        "doc_id", "pos", "page_idx", "at", "reference",
        F.coalesce("best", F.lit("")).alias("resolved_entity"),
        F.when(has & F.col("by_rule"), F.col("rule.confidence")).when(has, GENERIC_REFERENCE).otherwise(0.0).alias("confidence"),
        F.when(has & F.col("by_rule"), "rule").when(has, "context").otherwise("unresolved").alias("method"),
        F.left(F.col("context"), F.lit(200)).alias("context_snippet"),
    )


@F.pandas_udf(StringType())
def _most_similar(contexts: pd.Series, names: pd.Series) -> pd.Series:
    def pick(context: str | None, known) -> str | None:
        if context is None or known is None or not len(known):
            return None
        return max(known, key=lambda e: SequenceMatcher(None, context[-100:], e).ratio())

    return pd.Series([pick(c, k) for c, k in zip(contexts, names, strict=True)], dtype=object)
