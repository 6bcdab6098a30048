"""Tables and paragraphs that pages have torn apart: gaps and islands over the blocks of each document.

Blocks: doc_id, pos (order in the document), page_idx, type, text, data.  All windows are by document in the same
order, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import grid_to_markdown, markdown_rows, width
from ..functions.numeric import strip
from ..functions.text import continues, join_char, similarity
from ..functions.vocabulary import HEADER_WORDS, NUMERIC_CELL, UNICODE


def payload(*sources: Column, markdown: Column | None = None) -> Column:
    """The first source with rows, else the rows of the Markdown, else none."""
    out = F.lit(None)
    if markdown is not None:
        out = F.when(F.coalesce(markdown, F.lit("")) != "", markdown_rows(markdown))
    for source in reversed(sources):
        out = F.when(F.coalesce(F.size(source), F.lit(0)) > 0, source).otherwise(out)
    return F.coalesce(out, F.array().cast("array<array<string>>"))


def header_like(row: Column) -> Column:
    """At most two fifths digits, and one of the words of headers."""
    text = F.array_join(row, "")
    bare = strip(text)
    digits = F.regexp_count(bare, F.lit(r"(?U)\d"))
    return F.coalesce((bare != "") & (digits / F.length(bare) <= 0.4) & text.rlike("|".join(HEADER_WORDS)), F.lit(False))


def profile(rows: Column) -> Column:
    """Per column the share of numeric cells."""
    numeric = lambda c: F.regexp_replace(strip(c), "[,，]", "").rlike(UNICODE + NUMERIC_CELL)

    def share(i: Column) -> Column:
        cells = F.filter(F.transform(rows, lambda r: F.get(r, i)), lambda c: c.isNotNull())
        return F.size(F.filter(cells, numeric)) / F.greatest(F.size(cells), F.lit(1))

    return F.transform(F.sequence(F.lit(0), F.greatest(width(rows) - 1, F.lit(0))), share)


def same_profile(a: Column, b: Column) -> Column:
    """The last three rows of one and the first three of the other agree in three fifths of the columns."""
    x, y = profile(F.slice(a, -F.least(F.size(a), F.lit(3)), F.lit(3))), profile(F.slice(b, F.lit(1), F.lit(3)))
    n = F.least(F.size(x), F.size(y))
    close = F.size(F.filter(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.abs(p - q) < 0.4), lambda ok: ok))
    return close >= n * F.lit(0.6)


def continues_table(prev: str, cur: str, like: Column) -> Column:
    """Whether the fragment ``cur`` goes on with ``prev`` (struct columns page_idx, data, cols); ``like``:
    similarity of their first rows, needed only if both look like headers."""
    pa, pb = F.coalesce(F.col(f"{prev}.page_idx"), F.lit(-1)), F.coalesce(F.col(f"{cur}.page_idx"), F.lit(-1))
    a, b = F.col(f"{prev}.data"), F.col(f"{cur}.data")
    known = (pa >= 0) & (pb >= 0)
    ca, cb = width(a), width(b)
    ha, hb = header_like(F.get(a, F.lit(0))), header_like(F.get(b, F.lit(0)))
    meta = (F.coalesce(F.col(f"{prev}.cols"), F.lit(0)) != 0) & (F.col(f"{prev}.cols") == F.col(f"{cur}.cols"))
    return F.coalesce(
        F.when(known & (F.abs(pb - pa) > 1), False)
        .when((F.size(a) == 0) | (F.size(b) == 0), meta)
        .when(F.abs(ca - cb) > 1, False)
        .when(ha & hb, like > 0.7)
        .when(~hb, True)
        .when((ca == cb) & (ca > 0) & same_profile(a, b), True)
        .otherwise(known & (ca == cb) & (ca > 0)),
        F.lit(False),
    )


def in_order() -> tuple[Window, Column]:
    """By document; pages that aren't known sort as page 0."""
    page = F.coalesce(F.col("page_idx"), F.lit(0))
    return Window.partitionBy("doc_id").orderBy(page, "pos"), page


def table_groups(blocks: DataFrame, exact: bool = True) -> DataFrame:
    """The table blocks with ``grp``: numbers of the runs of fragments, per document.  Each fragment is compared
    with the one before it.  Without ``exact``, repeated headers must be equal, and no Python runs."""
    order, _ = in_order()
    t = blocks.where("type = 'table'").withColumn("cur", F.struct("page_idx", "data", "cols"))
    t = t.withColumn("prev", F.lag("cur").over(order))
    first = lambda c: F.array_join(F.get(F.col(f"{c}.data"), F.lit(0)), "|")
    if exact:
        # the costly comparison only where both begin with a header
        both = header_like(F.get(F.col("prev.data"), F.lit(0))) & header_like(F.get(F.col("cur.data"), F.lit(0)))
        t = t.withColumn("_l", F.when(both, first("prev"))).withColumn("_r", F.when(both, first("cur"))).withColumn("_like", similarity("_l", "_r"))
    else:
        t = t.withColumn("_like", (first("prev") == first("cur")).cast("double"))
    starts = (~continues_table("prev", "cur", F.col("_like"))).cast("int")
    return t.withColumn("grp", F.sum(starts).over(order)).drop("cur", "prev", "_l", "_r", "_like")


def fold_fragments(fragments: Column, same_head) -> Column:
    """Rows of the fragments in order: a repeated header goes; a row that was cut off is joined with the rest of it."""

    def join(rows: Column, f: Column) -> Column:
        data = F.when(same_head(F.get(rows, F.lit(0)), F.get(f, F.lit(0))) & header_like(F.get(f, F.lit(0))), F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))).otherwise(f)
        last, head, cols = F.element_at(rows, -1), F.get(data, F.lit(0)), width(rows)
        torn = (F.size(last) < cols) & (F.size(head) > 0) & (F.size(last) + F.size(head) <= cols + 1)
        whole = F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(F.slice(F.concat(last, head), F.lit(1), cols)), F.slice(data, F.lit(2), F.greatest(F.size(data) - 1, F.lit(0))))
        return F.when(F.size(data) == 0, rows).when(F.size(rows) == 0, data).when(torn, whole).otherwise(F.concat(rows, data))

    empty = F.array().cast("array<array<string>>")
    return F.aggregate(F.slice(fragments, F.lit(2), F.greatest(F.size(fragments) - 1, F.lit(0))), F.coalesce(F.get(fragments, F.lit(0)), empty), join)


def merge_tables(blocks: DataFrame, exact: bool = True) -> DataFrame:
    """One row a merged table: doc_id, pos and page_idx of the first fragment, data, rows, cols, markdown,
    source_indices, pages, fragments, confidence."""
    groups = table_groups(blocks, exact)
    _, page = in_order()
    parts = groups.groupBy("doc_id", "grp").agg(F.sort_array(F.collect_list(F.struct(page.alias("o"), "pos", "page_idx", "data"))).alias("f"))
    equal = lambda a, b: F.array_join(a, "|") == F.array_join(b, "|")
    data = F.transform("f", lambda x: x["data"])
    if exact:
        # heads of the fragments that the first one's header is like
        heads = parts.select("doc_id", "grp", F.posexplode("f").alias("i", "x"), F.array_join(F.get(F.get(data, F.lit(0)), F.lit(0)), "|").alias("a"))
        heads = heads.where("i > 0").withColumn("b", F.array_join(F.get(F.col("x.data"), F.lit(0)), "|")).where(header_like(F.get(F.col("x.data"), F.lit(0))))
        alike = heads.where(similarity("a", "b") > 0.7).groupBy("doc_id", "grp").agg(F.collect_set("b").alias("alike"))
        parts = parts.join(alike, ["doc_id", "grp"], "left")
        test = lambda a, b: F.coalesce(F.array_contains(F.col("alike"), F.array_join(b, "|")), F.lit(False))
    else:
        test = equal
    merged = parts.withColumn("data", fold_fragments(data, test))
    several = F.size("f") > 1
    return merged.select(
        "doc_id",
        F.get("f", F.lit(0))["pos"].alias("pos"),
        F.get("f", F.lit(0))["page_idx"].alias("page_idx"),
        "data",
        F.size("data").alias("rows"),
        width(F.col("data")).alias("cols"),
        grid_to_markdown(F.col("data")).alias("markdown"),
        F.transform("f", lambda x: x["pos"]).alias("source_indices"),
        F.transform("f", lambda x: F.coalesce(x["page_idx"], F.lit(-1))).alias("pages"),
        F.size("f").alias("fragments"),
        F.when(several, F.lit(0.85)).alias("confidence"),
    )


def merge_texts(blocks: DataFrame) -> DataFrame:
    """One row a paragraph: text blocks that follow each other with nothing between are joined while each goes on
    with the one before it: doc_id, pos, page_idx, text, chain_length, source_indices, confidence."""
    order, page = in_order()
    t = blocks.withColumn("_prev", F.lag(F.struct("type", "text")).over(order))
    joins = (F.col("type") == "text") & (F.col("_prev.type") == "text") & continues(F.coalesce("_prev.text", F.lit("")), F.coalesce("text", F.lit("")))
    t = t.withColumn("_new", F.coalesce(~joins, F.lit(True)))
    t = t.withColumn("grp", F.sum(F.col("_new").cast("int")).over(order))
    t = t.withColumn("_glue", F.when(F.col("_new"), F.lit("")).otherwise(join_char(F.col("_prev.text"), F.col("text"))))
    parts = t.where("type = 'text'").groupBy("doc_id", "grp").agg(F.sort_array(F.collect_list(F.struct(page.alias("o"), "pos", "page_idx", "_glue", "text"))).alias("f"))
    return parts.select(
        "doc_id",
        F.get("f", F.lit(0))["pos"].alias("pos"),
        F.get("f", F.lit(0))["page_idx"].alias("page_idx"),
        F.array_join(F.transform("f", lambda x: F.concat(x["_glue"], F.coalesce(x["text"], F.lit("")))), "").alias("text"),
        F.size("f").alias("chain_length"),
        F.transform("f", lambda x: x["pos"]).alias("source_indices"),
        F.when(F.size("f") > 1, F.lit(0.9)).alias("confidence"),
    )


def merge_document(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks after merging tables, then texts; and the operations: operation_type, source_indices,
    source_page_indices, confidence, reason."""
    tables = merge_tables(blocks)
    kept = ["doc_id", "pos", "page_idx", "type", "text", "data", "cols"]
    rest = blocks.where("type <> 'table'").select(*kept)
    mid = rest.unionByName(tables.select("doc_id", "pos", "page_idx", F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), "data", "cols"))
    texts = merge_texts(mid)
    out = mid.where("type <> 'text'").unionByName(texts.select("doc_id", "pos", "page_idx", F.lit("text").alias("type"), "text", F.lit(None).cast("array<array<string>>").alias("data"), F.lit(None).cast("int").alias("cols")))
    ops = tables.where("fragments > 1").select(
        "doc_id", F.lit("table_merge").alias("operation_type"), "source_indices", F.col("pages").alias("source_page_indices"), "confidence", F.format_string("%d fragments", "fragments").alias("reason")
    )
    told = texts.where("chain_length > 1").select(
        "doc_id", F.lit("text_merge").alias("operation_type"), "source_indices", F.array(F.coalesce("page_idx", F.lit(-1))).alias("source_page_indices"), "confidence", F.format_string("%d parts", "chain_length").alias("reason")
    )
    return out, ops.unionByName(told)
