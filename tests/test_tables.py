"""Numbers, grids and tables against fixed vectors."""

import pytest
from pyspark.sql import functions as F

from docgrid.functions import grid as G
from docgrid.functions.numeric import cn_numeral, extract_numeric
from docgrid.operators import tables


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


NUMBERS = {
    "1,234,567.89": (1234567.89, "", False, False, 1.0),
    "(1,234.56)": (-1234.56, "", True, False, 1.0),
    "12.5%": (12.5, "%", False, True, 1.0),
    "1,234.56万元": (1234.56, "万元", False, False, 1.0),
    "-5,678.90": (5678.9, "", True, False, 1.0),
    "(-5)": (5.0, "", True, False, 1.0),
    "−5": (None, "", False, False, 0.2),
    "壹佰贰拾叁万": (1230000.0, "万", False, False, 1.0),
    "拾万": (200000.0, "万", False, False, 1.0),
    "壹亿贰仟万": (1000030000000.0, "亿", False, False, 1.0),
    "万元": (10000.0, "万元", False, False, 1.0),
    "1万": (1.0, "万", False, False, 1.0),
    "—": (None, "", False, False, 1.0),
    "N/A": (None, "", False, False, 1.0),
    "": (None, "", False, False, 1.0),
    "营业收入": (None, "", False, False, 0.2),
    "2024年": (2024.0, "", False, False, 1.0),
    ",": (None, "", False, False, 0.2),
    "１２３元": (123.0, "元", False, False, 1.0),
    "\u3000(٣,٤٥٦.７)\xa0": (-3456.7, "", True, False, 1.0),
    "- 5": (5.0, "", True, False, 1.0),
    "-\t5": (None, "", False, False, 0.2),
    "-\xa05": (None, "", False, False, 0.2),
}


def test_numbers(spark):
    found = values(spark, list(NUMBERS), extract_numeric)
    assert {t: tuple(v) for t, v in zip(NUMBERS, found, strict=True)} == NUMBERS


def test_documented_signs(spark):
    found = values(spark, ["-5,678.90", "−5", "(7)"], lambda c: extract_numeric(c, "documented")["value"])
    assert found == [-5678.9, -5.0, -7.0]


def test_numerals(spark):
    assert values(spark, ["零", "十", "二十", "一百零五", "x", "3十", "五"], cn_numeral) == [None, 10.0, 20.0, 105.0, None, None, 5.0]


def test_markdown_round_trip(spark):
    rows = [["a", "b"], ["1", "x y"], ["", "z"]]
    df = spark.createDataFrame([(rows,), ([["only"]],), ([],)], "g array<array<string>>").withColumn("m", G.grid_to_markdown(F.col("g")))
    out = df.withColumn("back", G.markdown_rows(F.col("m"))).collect()
    assert out[0].m == "| a | b |\n| --- | --- |\n| 1 | x y |\n|  | z |" and out[0].back == rows
    assert out[1].m.count("\n") == 1 and out[2].m == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\tb\nc", [["a", "b"], ["c", ""]]), ("| a | b |\n|c|", [["a", "b"], ["c", ""]]), ("a  b   c\n\n d", [["a", "b", "c"], ["d", "", ""]]), (" \n", [])],
)
def test_text_to_grid(spark, text, want):
    assert values(spark, [text], G.text_to_grid) == [want]


def test_html():
    assert G.html_grid("<table><tr><th colspan=2>Header</th></tr><tr><td>A</td><td>B</td></tr></table>") == [["Header", "Header"], ["A", "B"]]
    assert G.html_grid("<tr><td rowspan=3>a</td><td>b</td></tr><tr><td>c</td></tr>") == [["a", "b"], ["a", "c"], ["a", ""]]
    assert G.html_grid(None) == []
    blocks = G.html_content("<title> T </title><script>x</script><h1>H</h1><ul><li>one</li></ul><p>p &amp; q</p><table><tr><td>1</td></tr></table><img src='s' alt='a'>")
    assert [(b["type"], b["markdown"]) for b in blocks] == [("text", "# T"), ("text", "# H"), ("text", "- one"), ("text", "p & q"), ("table", "| 1 |\n| --- |"), ("image", None)]


def test_csv(spark):
    df = spark.createDataFrame([([["a", 'x"y', "1,2"], [""]],)], "g array<array<string>>")
    assert df.select(G.grid_to_csv(F.col("g"))).first()[0] == 'a,"x""y","1,2"\r\n""\r\n'


def test_parse_tables(spark):
    grid = [["项目", "本期金额", "上期金额", "合计"], ["货币资金", "100.00", "50.00", "150.00"], ["应收账款", "10", "5", "99"], ["存货", "1", "2", "3"]]
    odd = [[""]]
    out = tables.parse_tables(spark.createDataFrame([(1, grid), (2, odd)], "k int, grid array<array<string>>")).orderBy("k").collect()
    assert (out[0].type, out[0].num_rows, out[0].num_cols, out[0].checks, out[0].failures) == ("balance_sheet", 3, 4, 3, 1)
    assert [c.passed for c in out[0].row_sum_checks] == [True, False, True]
    scores = {(c.row, c.col): (c.score, c.reason) for c in out[0].confidence_scores}
    assert scores[0, 0] == (0.2, "numeric_parse_issue") and scores[1, 1] == (0.85, "row_sum_failed") and scores[0, 1] == (1.0, "")
    assert out[1].type == "generic" and out[1].checks == 0
    none = tables.parse_tables(spark.createDataFrame([(1, grid)], "k int, grid array<array<string>>"), verify=False).first()
    assert none.checks == 0


def test_merged_cells():
    assert G.merged_cells([["a", "a", "b"], ["a", "a", "c"], ["d", "c", "c"]]) == [
        {"row_start": 0, "col_start": 0, "row_end": 2, "col_end": 2},
        {"row_start": 2, "col_start": 1, "row_end": 3, "col_end": 3},
    ]
