"""Charts: a rule for their kind from line features, and series laid out as a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chart_kind(horizontal: Column, vertical: Column, edges: Column) -> Column:
    """type and confidence from the numbers of straight lines and the share of edge pixels."""
    out = lambda kind, sure: F.struct(F.lit(kind).alias("chart_type"), F.lit(sure).alias("confidence"))
    return (
        F.when((horizontal > 10) & (vertical > 10) & (edges > 0.08), out("heatmap", 0.3))
        .when((horizontal > 5) & (vertical > 2), out("bar_chart", 0.35))
        .when((horizontal > 5) & (vertical < 2), out("line_chart", 0.3))
        .when(edges < 0.03, out("pie_chart", 0.25))
        .when((horizontal < 3) & (vertical < 3) & (edges > 0.05), out("scatter_plot", 0.25))
        .otherwise(out("unknown", 0.1))
    )


def keep_chart(kind: Column, exists: Column) -> Column:
    """Charts worth a closer look: the file is there, and the kind is known or not quite unsure."""
    return exists & ~((kind["chart_type"] == "unknown") & (kind["confidence"] < 0.1))


def series_to_table(series: Column) -> Column:
    """``series``: array of struct(name, labels, values).  Header of names, then one row a label."""
    most = lambda field: F.coalesce(F.array_max(F.transform(series, lambda s: F.size(s[field]))), F.lit(0))
    n = F.when(most("labels") > 0, most("labels")).otherwise(most("values"))
    names = F.transform(series, lambda s, i: F.when(F.coalesce(s["name"], F.lit("")) == "", F.concat(F.lit("Series_"), (i + 1).cast("string"))).otherwise(s["name"]))
    label = lambda i: F.coalesce(F.get(F.filter(F.transform(series, lambda s: F.get(s["labels"], i)), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))
    row = lambda i: F.concat(F.array(label(i)), F.transform(series, lambda s: F.coalesce(F.get(s["values"], i), F.lit(""))))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), row)
    table = F.concat(F.array(F.concat(F.array(F.lit("Label")), names)), rows)
    return F.when((F.size(series) > 0) & (n > 0), table).otherwise(F.slice(table, 1, 0))


def ocr_title(text: Column) -> Column:
    """title and notes of a chart from plain recognition: the first line, and the four after it."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.struct(F.coalesce(F.get(rows, F.lit(0)), F.lit("")).alias("title"), F.array_join(F.slice(rows, 2, 4), "\n").alias("notes"))
