"""Tools by name: anything that takes (frame, parameters) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import charts, entities, imaging, merge, tables
from .plans import control

Tool = Callable[..., DataFrame]

TOOLS: dict[str, Tool] = {
    "table_parser": tables.parse_tables,
    "cross_page_merger": lambda df, **_: merge.merge_document(df)[0],
    "reference_resolver": lambda df, **_: entities.resolve_references(df),
    "chart_analyzer": lambda df, series="series", **_: df.withColumn("table", charts.series_to_table(F.col(series))),
    "image_enhancer": lambda df, metrics="m", **_: df.withColumn("flags", imaging.quality_flags(metrics)),
    "verifier": lambda df, **_: df.withColumn("verdict", control.builtin_score(*[F.col(c) for c in ("chars", "pages", "blocks", "tables", "images", "failed")])),
    "exporter": lambda df, kind="json", **_: tables.with_output(df, kind),
}


def register(name: str, tool: Tool) -> None:
    TOOLS[name] = tool


def apply(name: str, df: DataFrame, **params) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"no tool named {name}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](df, **params)
