"""Queries on inputs that are longer or odder than the test tables have."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docgrid import queries
from docgrid.functions.vocabulary import ENTITIES, GENERIC_REFERENCE, REFERENCE_RULES, REFERENCES


def test_long_text_is_merged_whole(spark, tmp_path):
    """More pieces than 400, code points beyond the first plane and line feeds among them."""
    text = "𝄞Ab.\n" * 30_000
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["text_merge_chains"](spark, str(tmp_path))
    # pieces end with a line feed after a full stop, so none goes on
    assert out.agg(F.count("*"), F.sum("chars"), F.max("pos")).first()[:] == (834, 150_000, 833)


def test_all_parts_of_a_very_long_document(spark, tmp_path):
    spark.createDataFrame([(1, 300_000), (2, 39)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["page_chunks"](spark, str(tmp_path))
    assert out.agg(F.count("*"), F.max("start"), F.max("stop")).first()[:] == (250, 7470, 7500)


def test_requests_are_read_whole(spark, tmp_path):
    """Words far behind the beginning count; a null text is an empty request."""
    rows = [(7, 0, "x" * 500 + " 图表和表格"), (7, 1, "y" * 500 + " comprehensive"), (7, 2, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    told = lambda name: {r.turn: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assess, simple = told("task_assess"), told("task_assess_simple")
    assert assess[0].task_types == "document_parse,table_extract,financial_report,chart_analysis" and assess[0].difficulty == "hard"
    assert {k: r.difficulty for k, r in simple.items()} == {0: "hard", 1: "hard", 2: "easy"}
    plan = {(r.turn, r.tool_name) for r in queries.QUERIES["task_plan"](spark, str(tmp_path)).collect()}
    assert {(0, "table_parser"), (0, "chart_analyzer"), (2, "verifier")} <= plan


def test_quality_reads_whole_texts(spark, tmp_path):
    """Asked for tables behind place 40, merged as the added word asks: 0.05 more."""
    spark.createDataFrame([(2, "z" * 90 + " 表格"), (25202, "z" * 90 + " 表哥")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.quality_score for r in queries.QUERIES["quality_score"](spark, str(tmp_path)).collect()}
    assert got[2] != got[25202]


def brute_entities(blocks: list[str]) -> dict[str, list[str]]:
    """Category to its entities, categories and entities in the order of their first mention."""
    known: dict[str, list[str]] = {}
    for text in blocks:
        for category, pattern in ENTITIES:
            for m in re.finditer(pattern, text):
                x = m[1].strip()
                if len(x) >= 2 and x not in known.setdefault(category, []):
                    known[category].append(x)
    return {c: xs for c, xs in known.items() if xs}


def brute_references(blocks: list[str]) -> list[tuple]:
    known, out = brute_entities(blocks), []
    for pos, text in enumerate(blocks):
        found: dict[int, str] = {}
        for p in REFERENCES:
            for m in re.finditer(p, text):
                found.setdefault(m.start(), m[0])
        for at, reference in found.items():
            context = text[max(0, at - 120) : at + 120]
            category, sure = next(((c, s) for c, s, ws in REFERENCE_RULES if re.search("|".join(ws), reference)), (None, None))
            names = known.get(category) or [x for xs in known.values() for x in xs]
            inside = [x for x in names if x in context]
            if not names:
                out.append((pos, reference, "", 0.0, "unresolved"))
                continue
            best = max(inside, key=context.rfind) if inside else max(names, key=lambda x: SequenceMatcher(None, context[-100:], x).ratio())
            out.append((pos, reference, best, sure if category in known else GENERIC_REFERENCE, "rule" if category in known else "context"))
    return out


def test_entities_and_references_of_all_blocks(spark, tmp_path):
    """Both queries, rows of the second block too, against brute force."""
    rows = [(k, 1234.5 * k - 2000) for k in range(1, 8)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    docs: dict[int, list[str]] = {}
    for r in queries.sentences(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")).orderBy("doc_id", "pos").collect():
        docs.setdefault(r.doc_id, []).append(r.text)
    got = sorted((r.doc_id, r.category, r.text, r.ord) for r in queries.QUERIES["entity_registry"](spark, str(tmp_path)).collect())
    assert got == sorted((d, c, x, i) for d, blocks in docs.items() for c, xs in brute_entities(blocks).items() for i, x in enumerate(xs))
    out = queries.QUERIES["reference_resolution"](spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.pos, r.reference, r.resolved_entity, r.confidence, r.method) for r in out)
    assert got == sorted((d, *x) for d, blocks in docs.items() for x in brute_references(blocks))
    assert {r.pos for r in out} == {0, 1}


def test_references_and_entities_meet_without_broadcast(spark, tmp_path):
    """Neither side may be gathered on the driver, even where Spark takes it for small."""
    spark.createDataFrame([(k, 10.0 * k) for k in range(1, 50)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    out = queries.QUERIES["reference_resolution"](spark, str(tmp_path))
    planned = out._jdf.queryExecution().executedPlan().toString()
    assert len(out.collect()) == 3 * 49
    assert "Broadcast" not in planned + out._jdf.queryExecution().executedPlan().toString()


def test_zscores_are_rounded_once(spark, tmp_path):
    """Every outlier among 30 equal steps, by whole numbers; a score of x.x45 and more must not go up twice.  Customers
    without a nation are in no table."""
    nations = {n: [*range(1, 31), 200 + n] for n in range(200)}
    rows = [(1000 * n + i + 1, n, float(x)) for n, xs in nations.items() for i, x in enumerate(xs)] + [(900_001 + i, None, float(x)) for i, x in enumerate(nations[0])]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")

    def scores(xs: list[int]) -> list[float]:
        mean = sum(xs) / len(xs)
        std = (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5
        return [z for x in xs if (z := abs(x - mean) / std) > 5]

    want = {n: zs for n, xs in nations.items() if (zs := scores(xs))}
    assert any(round(round(z, 2), 1) != round(z, 1) for zs in want.values() for z in zs)  # else the test tells nothing
    got = {r.c_nationkey: (r.value, r.z_score) for r in queries.QUERIES["anomaly_zscore"](spark, str(tmp_path)).collect()}
    assert got == {n: (200.0 + n, round(z, 1)) for n, (z,) in want.items()}
