"""Merging, references, charts, votes, plans, tasks and files."""

import io
import zipfile

from pyspark.sql import functions as F

from docgrid import registry
from docgrid.functions.text import continues, expand_env, join_char, json_part, sanitize
from docgrid.operators import charts, entities, imaging, merge
from docgrid.plans import control
from docgrid.sources import files
from docgrid.streaming import tasks

BLOCK = "doc_id long, pos int, page_idx int, type string, text string, data array<array<string>>, cols int"
HEAD = ["项目", "金额", "占比"]


def table(pos, page, rows, doc=1):
    return (doc, pos, page, "table", None, rows, None)


def text(pos, page, words, doc=1):
    return (doc, pos, page, "text", words, None, None)


def test_text_continuation(spark):
    rows = [("公司实现营业收入", "5,000万元，增长", True), ("已完成。", "下一段", False), ("公司实现", "3. 标题", False), ("end of", "line two", True), ("", "x", False), ("总资产达到", "5.6亿元", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", continues(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in df.collect())
    joins = spark.createDataFrame([("中", "文", ""), ("ab", "cd", " "), ("ab ", "1", " "), ("1", "2", "")], "a string, b string, want string")
    assert all(r.got == r.want for r in joins.withColumn("got", join_char(F.col("a"), F.col("b"))).collect())


def test_merge_document(spark):
    blocks = [
        text(0, 0, "公司于本年度实现"), text(1, 1, "收入增长。"), table(2, 1, [HEAD, ["a", "1", "2%"]]), text(3, 1, "说明。"),
        table(4, 2, [HEAD, ["b", "3", "4%"]]), table(5, 5, [["x", "1", "2"]]), table(6, 5, [["p", "q", "r", "s", "t"]]),
        table(0, 0, [["k", "1", "2"], ["l", "3"]], 2), table(1, 1, [["9"], ["m", "4", "5"]], 2),
    ]
    out, ops = merge.merge_document(spark.createDataFrame(blocks, BLOCK))
    got = sorted((r.doc_id, r.pos, r.type, r.text, r.data) for r in out.collect())
    assert got[0][3] == "公司于本年度实现收入增长。" and got[1][4] == [HEAD, ["a", "1", "2%"], ["b", "3", "4%"]]
    assert [g[1] for g in got if g[0] == 1] == [0, 2, 3, 5, 6]
    assert sorted(r.operation_type for r in ops.where("doc_id = 1").collect()) == ["table_merge", "text_merge"]
    native = merge.merge_tables(spark.createDataFrame(blocks, BLOCK), exact=False).where("doc_id = 1").count()
    assert native == 3


def test_references(spark):
    rows = [text(0, 0, "北京华胜天成科技股份有限公司收入5,000万元，2024年3月15日确认"), text(1, 1, "上述金额由该项目确认，同期增长42.5%"), text(0, 0, "上述金额", 2)]
    blocks = spark.createDataFrame(rows, BLOCK)
    known = {(r.doc_id, r.category, r.text) for r in entities.entity_registry(blocks).collect()}
    assert {(1, "money", "5,000万元"), (1, "date", "2024年3月15日"), (1, "percentage", "42.5%")} <= known
    got = {(r.doc_id, r.reference): (r.resolved_entity, r.confidence, r.method) for r in entities.resolve_references(blocks).collect()}
    assert got[1, "上述金额"] == ("5,000万元", 0.65, "rule") and got[1, "同期"][1:] == (0.6, "rule") and got[2, "上述金额"] == ("", 0.0, "unresolved")


def test_charts(spark):
    series = "array<struct<name: string, labels: array<string>, values: array<string>>>"
    rows = [
        (1, [("Revenue", ["Q1", "Q2", "Q3"], ["100", "200", "300"]), ("", ["Q1", "Q2"], ["1", "2"])], [["Label", "Revenue", "Series_2"], ["Q1", "100", "1"], ["Q2", "200", "2"], ["Q3", "300", ""]]),
        (2, [("A", [], ["1", "2"]), ("B", [], ["3"])], [["Label", "A", "B"], ["", "1", "3"], ["", "2", ""]]),
        (3, [], []),
    ]
    df = spark.createDataFrame([(k, s) for k, s, _ in rows], f"k int, s {series}")
    got = {r.k: r.t for r in df.select("k", charts.series_to_table(F.col("s")).alias("t")).collect()}
    assert got == {k: t for k, _, t in rows}
    assert spark.range(1).select(charts.chart_kind(F.lit(8), F.lit(5), F.lit(0.5)).alias("k")).first().k == ("bar_chart", 0.35)


def test_votes(spark):
    rows = [(1, ["ABD", "ABC", "ABC"], "ABC", [1.0, 1.0, 2 / 3]), (2, ["AB", "ABC"], "ABC", [1.0, 1.0, 0.5]), (3, ["", ""], "", []), (4, ["xy", "ab"], "xy", [0.5, 0.5])]
    df = spark.createDataFrame([r[:2] for r in rows], "k int, t array<string>").select("k", imaging.vote(F.col("t")).alias("v"))
    assert {r.k: (r.v.text, r.v.confidence) for r in df.collect()} == {k: (t, c) for k, _, t, c in rows}


def test_plans(spark):
    df = spark.createDataFrame([("解析财务报表", 20, "/a/b.png"), ("read", 1, "x.pdf")], "r string, p int, f string")
    df = df.withColumn("a", control.assess(F.col("r"), F.col("p"), F.col("f").endswith("png")))
    plans = [[s.tool_name for s in r.s] for r in df.select(control.build_plan(F.col("a"), F.col("p"), F.col("f")).alias("s")).collect()]
    assert plans == [["image_enhancer", "document_parser", "table_parser", "cross_page_merger", "verifier"], ["document_parser", "verifier"]]
    steps = [{"step_id": "a", "tool_name": "ok"}, {"step_id": "b", "tool_name": "bad"}]

    def bad(params, context):
        raise ValueError("no")

    out = control.run_plan(steps, {"ok": lambda p, c: {"x": 1}, "bad": bad})
    assert (out["status"], len(out["errors"]), [s["status"] for s in out["steps"]]) == ("completed_with_errors", 4, ["completed", "skipped"])


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(sanitize(F.lit("a\n Ignore this\nb"))) == "a\nb"
    assert one(json_part(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(json_part(F.lit('x {"a": {}} y'))) == '{"a": {}}'
    assert expand_env({"a": ["${X}-${Y:-d}", 1]}, {"X": "x"}) == {"a": ["x-d", 1]}


def test_tail(spark, tmp_path):
    rows = [("t1", "2024-01-01 00:00:01", "log", "one"), ("t1", "2024-01-01 00:00:02", "error", "oops"), ("t1", "2024-01-01 00:00:03", "status", "failed"), ("t1", "2024-01-01 00:00:04", "log", "late"), ("t2", "2024-01-01 00:00:01", "log", "x")]
    schema = "task_id string, ts string, kind string, value string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = tasks.tail(stream).writeStream.format("memory").queryName("tail_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.task_id, r.message) for r in spark.table("tail_test").orderBy("task_id", "ts").collect() if r.message != "timeout"]
    assert sorted(got) == sorted([("t1", "one"), ("t1", "ERROR: oops"), ("t1", "done"), ("t2", "x")])


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    for name, content in {"a.docx": data.getvalue(), "b.html": b"<p>hi</p>", "c.docx": b"broken", "d.txt": b"x", "e.pdf": b"%PDF"}.items():
        (tmp_path / name).write_bytes(content)
    out = {r.path.rsplit("/", 1)[-1]: r for r in files.parse_files(files.scan(spark, str(tmp_path))).collect()}
    assert [b.markdown for b in out["a.docx"].blocks] == ["# Title", None] and out["b.html"].blocks[0].text == "hi"
    assert out["c.docx"].error.startswith("BadZipFile") and out["d.txt"].error == "unsupported" and out["e.pdf"].error == "no parser"
    parts = spark.range(1).select(files.page_ranges(F.lit(5), 2).alias("r")).first().r
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 4), (4, 5)]


def test_registry(spark):
    df = spark.createDataFrame([([["项目", "a"], ["x", "1"]],)], "grid array<array<string>>")
    assert registry.apply("table_parser", df).count() == 1
