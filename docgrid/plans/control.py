"""Assessing requests, laying out plans, scoring results and choosing what comes next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..functions.vocabulary import ASSESS_WORDS, IMAGE_SUFFIXES, MAX_ERRORS, MAX_REPLANS, MAX_RETRIES, PLANNER_WORDS, QUALITY_THRESHOLD, REPAIRS, VERIFY_WORDS


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Any of the words anywhere in the lower-case text, inside words too."""
    return F.coalesce(F.lower(text).rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(False))


def _names(*items: Column | str) -> Column:
    return F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in items]))


def _if(test: Column, name: str) -> Column:
    return F.when(test, F.lit(name))


def assess(request: Column, pages: Column, is_image: Column) -> Column:
    """task_types, difficulty, preprocessing, recommended_tools and estimated_subtasks of a request."""
    table, chart, poor, export = (has_any(request, ASSESS_WORDS[k]) for k in ("table", "chart", "poor", "export"))
    many = F.coalesce(pages, F.lit(1)) > 1
    tasks = _names(
        "document_parse", _if(table, "table_extract"), _if(table, "financial_report"), _if(chart, "chart_analysis"), _if(poor, "low_quality_ocr"),
        _if(many, "cross_page_merge"), _if(export, "structured_export"),
    )
    repairs = _names(*[_if(poor, x) for x in REPAIRS], _if(is_image, "enhance"))
    return F.struct(
        tasks.alias("task_types"),
        F.when(table | poor, "hard").otherwise("medium").alias("difficulty"),
        repairs.alias("preprocessing"),
        _names("document_parser", _if(table, "table_parser"), _if(chart, "chart_analyzer"), _if(poor, "image_enhancer")).alias("recommended_tools"),
        (F.size(tasks) + F.size(repairs) + 1).alias("estimated_subtasks"),
    )


def assess_simple(request: Column) -> Column:
    """The planner's own reading: fewer kinds, and a difficulty from words, kinds and length."""
    table, chart, poor, thorough = (has_any(request, PLANNER_WORDS[k]) for k in ("table", "chart", "poor", "thorough"))
    tasks = _names("document_parse", _if(table, "table_extract"), _if(chart, "chart_analysis"))
    repairs = _names(*[_if(poor, x) for x in REPAIRS])
    easy = (F.length(request) < 20) & (F.size(tasks) <= 1) & (F.size(repairs) == 0)
    hard = thorough | (F.size(tasks) >= 3) | (F.size(repairs) >= 2)
    return F.struct(
        tasks.alias("task_types"), F.when(hard, "hard").when(easy, "easy").otherwise("medium").alias("difficulty"), repairs.alias("preprocessing"),
        (F.size(tasks) + 2).alias("estimated_subtasks"),
    )


def build_plan(assessment: Column, pages: Column, path: Column) -> Column:
    """Steps in order: step_id, tool_name, dependencies, retry_count, max_retries, status.  Image repair only for
    images, tables, charts and merging as assessed, verification last and after all others."""
    has = lambda name: F.array_contains(assessment["task_types"], name)
    image = F.regexp_replace(suffix(path), r"^\.", "").isin(*IMAGE_SUFFIXES)
    kinds = _names(
        F.when(image & (F.size(assessment["preprocessing"]) > 0), F.lit("preprocess:image_enhancer")), "extract:document_parser",
        F.when(has("table_extract") | has("financial_report"), F.lit("table:table_parser")), F.when(has("chart_analysis"), F.lit("chart:chart_analyzer")),
        F.when(has("cross_page_merge") & (pages > 1), F.lit("merge:cross_page_merger")), "verify:verifier",
    )
    steps = F.transform(kinds, lambda k, i: F.struct(F.format_string("step_%03d_%s", i, F.substring_index(k, ":", 1)).alias("step_id"), F.substring_index(k, ":", -1).alias("tool_name")))
    ids = F.transform(steps, lambda s: s["step_id"])
    extract = F.filter(ids, lambda x: x.endswith("_extract"))

    def step(s: Column, i: Column) -> Column:
        kind = F.substring_index(s["step_id"], "_", -1)
        needs = F.when(kind.isin("preprocess", "extract", "verify"), F.slice(ids, F.lit(1), i)).otherwise(extract)
        return F.struct(s["step_id"].alias("step_id"), s["tool_name"].alias("tool_name"), needs.alias("dependencies"), F.lit(0).alias("retry_count"), F.lit(MAX_RETRIES).alias("max_retries"), F.lit("pending").alias("status"))

    return F.transform(steps, step)


def build_subtasks(assessment: Column, pages: Column) -> Column:
    """The planner's own plan: a table step per kind, each step after all before it: name, tool_name, dependencies."""
    types = assessment["task_types"]
    special = F.transform(F.filter(types, lambda t: t.isin("table_extract", "financial_report", "chart_analysis")), lambda t: F.when(t == "chart_analysis", F.lit("chart:chart_parser")).otherwise(F.lit("table:table_parser")))
    lead = _names(F.when(F.size(assessment["preprocessing"]) > 0, F.lit("preprocess:preprocessor")), "extract:document_parser")
    tail = _names(F.when(F.coalesce(pages, F.lit(1)) > 1, F.lit("merge:cross_page_merger")), "verify:verifier")
    numbered = F.transform(F.concat(lead, special, tail), lambda k, i: F.when(k.startswith("table:") | k.startswith("chart:"), F.concat(F.substring_index(k, ":", 1), F.lit("_"), i.cast("string"), F.lit(":"), F.substring_index(k, ":", -1))).otherwise(k))
    ids = F.transform(numbered, lambda k: F.substring_index(k, ":", 1))
    return F.transform(numbered, lambda k, i: F.struct(F.substring_index(k, ":", 1).alias("name"), F.substring_index(k, ":", -1).alias("tool_name"), F.slice(ids, F.lit(1), i).alias("dependencies")))


def quality_score(request: Column, chars: Column, pages: Column, blocks: Column, tables: Column, images: Column, steps: Column, completed: Column, charts: Column | None = None, merged: Column | None = None) -> Column:
    """0 to 1: content (up to 0.3), steps done (0.3), what the request asks for (0.2), richness (0.2).  Counts are
    columns; ``charts`` and ``merged`` are flags."""
    cap = lambda c, most, rate: F.least(F.lit(most), F.coalesce(c, F.lit(0)) * F.lit(rate))
    content = chars > 0
    got = F.when(content, F.lit(0.15) + cap(pages, 0.05, 0.001) + cap(blocks, 0.05, 0.0002) + F.when(chars > 100, F.least(F.lit(0.05), chars / 200000)).otherwise(0.0)).otherwise(0.0)
    plan = F.when(steps > 0, completed / steps * 0.3).otherwise(0.1)
    no = F.lit(False)
    asked = (
        F.when(has_any(request, VERIFY_WORDS["tables"]) & (tables > 0), 0.1).otherwise(0.0)
        + F.when(has_any(request, VERIFY_WORDS["charts"]) & (no if charts is None else charts), 0.05).otherwise(0.0)
        + F.when(has_any(request, VERIFY_WORDS["merge"]) & (no if merged is None else merged), 0.05).otherwise(0.0)
    )
    asked = F.when((asked == 0) & content, 0.1).otherwise(asked)
    rich = cap(tables, 0.1, 0.02) + cap(images, 0.05, 0.005) + cap(blocks, 0.05, 0.0001)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), got + plan + asked + rich))


def builtin_score(chars: Column, pages: Column, blocks: Column, tables: Column, images: Column, failed: Column) -> Column:
    """The verifier tool's score, and whether it passes; its parts add up to 0.6 at most."""
    cap = lambda c, most, rate: F.least(F.lit(most), c * F.lit(rate))
    content = F.when((blocks > 0) | (chars > 0), F.lit(0.15) + F.when(chars > 100, F.least(F.lit(0.1), chars / 200000)).otherwise(0.0) + cap(blocks, 0.05, 0.0002)).otherwise(0.0)
    covered = F.when((pages > 0) & (chars >= pages * 10), cap(pages, 0.15, 0.002)).otherwise(0.0)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), content + covered + cap(tables, 0.1, 0.02) + cap(images, 0.05, 0.005) - failed * 0.05))
    return F.struct(F.round(raw, 2).alias("quality_score"), (raw >= QUALITY_THRESHOLD).alias("passed"))


def after_execute(status: Column, index: Column, steps: Column) -> Column:
    return F.when(status == "error", "error_handler").when(steps.isNull() | (index >= steps), "verify_result").otherwise("execute_step")


def after_error(status: Column) -> Column:
    return F.when(status == "failed", "format_output").otherwise("execute_step")


def after_verify(passed: Column, replans: Column, retry_steps: Column) -> Column:
    """``passed`` is null where nothing was verified."""
    again = ~passed & (F.coalesce(replans, F.lit(0)) < MAX_REPLANS) & (F.coalesce(retry_steps, F.lit(0)) > 0)
    return F.when(F.coalesce(again, F.lit(False)), "prepare_replan").otherwise("format_output")


def replan(steps: Column, retry: Column) -> Column:
    """Steps to be done again are pending, with their count of retries at 0; and the first of them (from 0)."""
    again = lambda s: F.array_contains(retry, s["step_id"])
    fresh = F.transform(steps, lambda s: F.when(again(s), s.withField("status", F.lit("pending")).withField("retry_count", F.lit(0))).otherwise(s))
    first = F.array_position(F.transform(steps, again), True)
    return F.struct(fresh.alias("steps"), F.when(first > 0, first - 1).alias("target"))


def merge_results(raw: DataFrame, more: DataFrame, key: str = "doc_id", index: str = "table_index") -> DataFrame:
    """Tables of later steps join those of extraction unless one of the same index is there already."""
    return raw.unionByName(more.join(raw.select(key, index).distinct(), [key, index], "left_anti"))


def summary(blocks: Column, tables: Column, images: Column, text: Column) -> Column:
    return F.format_string("blocks=%d tables=%d images=%d\n%s", blocks, tables, images, F.left(text, F.lit(500)))


def run_plan(steps: list[dict], tools: dict[str, Callable[[dict, dict], dict]], context: dict | None = None) -> dict:
    """Steps one after the other on the driver: a failing one is tried ``max_retries`` times more, then skipped; too
    many errors end the run.  What a tool returns is seen by the tools after it."""
    context, errors, results = dict(context or {}), [], []
    for step in steps:
        step.setdefault("retry_count", 0)
        while True:
            try:
                found = tools[step["tool_name"]](step.get("params", {}), context)
            except Exception as e:  # a tool may raise anything
                errors.append(f"{step['step_id']}: {e}")
                if len(errors) > MAX_ERRORS:
                    return {"status": "failed", "results": results, "errors": errors, "steps": steps}
                if step["retry_count"] < step.get("max_retries", MAX_RETRIES):
                    step["retry_count"] += 1
                    continue
                step["status"] = "skipped"
                break
            step["status"] = "completed"
            results.append(found)
            context |= found
            break
    return {"status": "completed_with_errors" if errors else "completed", "results": results, "errors": errors, "steps": steps}
