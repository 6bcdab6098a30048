"""Queries over the driver's tables, and the same in DuckDB's SQL.

Tables, pages and tasks are made from the TPC-H-like tables by formatting their numbers as a document would; the SQL
works on the numbers themselves, so the two agree only if cells are read, checked and scored right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import grid as G
from .functions.numeric import cn_numeral, extract_numeric
from .functions.text import decode_data_uri, file_kind, json_part, safe_name, sanitize, suffix, trusted_url
from .functions.vocabulary import ASSESS_WORDS, ENTITIES, INJECTION, PLANNER_WORDS, VERIFY_WORDS
from .operators import charts, entities, imaging, merge, tables
from .plans import control
from .sources import files
from .streaming import tasks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def money(c: Column) -> Column:
    return F.format_number(c.cast("decimal(18,2)"), 2)


def _quoted(words) -> str:
    return "(" + "|".join(words) + ")"


# -- cells and tables -----------------------------------------------------------------------------

_VARIANTS = """
SELECT l_orderkey, l_partkey, l_linenumber % 7 AS v, l_extendedprice AS x,
  CASE l_linenumber % 7 WHEN 0 THEN format('{:,.2f}万元', l_extendedprice) WHEN 1 THEN format('({:,.2f})', l_extendedprice)
    WHEN 2 THEN format('{:.2f}%', l_discount * 100) WHEN 3 THEN format(' -{:,.2f}', l_extendedprice) WHEN 4 THEN '—'
    WHEN 5 THEN l_returnflag || l_linestatus ELSE format('{:,.2f} 亿元', l_extendedprice) END AS raw, l_discount AS d
FROM lineitem
"""


@query(f"""
WITH v AS ({_VARIANTS})
SELECT l_orderkey, l_partkey, raw,
  CASE v WHEN 0 THEN x WHEN 1 THEN -x WHEN 2 THEN round(d * 100, 2) WHEN 3 THEN x WHEN 6 THEN x END AS value,
  CASE v WHEN 0 THEN '万元' WHEN 2 THEN '%' WHEN 6 THEN '亿元' ELSE '' END AS unit,
  v IN (1, 3) AS is_negative, v = 2 AS is_percentage, CASE WHEN v = 5 THEN 0.2 ELSE 1.0 END::DOUBLE AS confidence
FROM v
""")
def numeric_extract(t):
    """every notation of a number; a leading minus is read twice, as documented for ``as_coded``."""
    x, v = F.col("l_extendedprice"), F.col("l_linenumber") % 7
    raw = (
        F.when(v == 0, F.concat(money(x), F.lit("万元"))).when(v == 1, F.concat(F.lit("("), money(x), F.lit(")")))
        .when(v == 2, F.concat(F.format_number((F.col("l_discount") * 100).cast("decimal(18,2)"), 2), F.lit("%"))).when(v == 3, F.concat(F.lit(" -"), money(x)))
        .when(v == 4, "—").when(v == 5, F.concat("l_returnflag", "l_linestatus")).otherwise(F.concat(money(x), F.lit(" 亿元")))
    )
    return t("lineitem").select("l_orderkey", "l_partkey", raw.alias("raw")).withColumn("n", extract_numeric(F.col("raw"))).select("l_orderkey", "l_partkey", "raw", "n.*")


@query("""
WITH d AS (SELECT p_partkey, p_partkey % 10 AS a, p_partkey // 10 % 10 AS b, p_size % 10 AS c FROM part)
SELECT p_partkey, translate(a || '佰' || b || '拾' || c || '万', '0123456789', '零壹贰叁肆伍陆柒捌玖') AS numeral,
  (greatest(a, 1) * 100 + greatest(b, 1) * 10 + CASE WHEN c = 0 THEN 10 ELSE c END)::DOUBLE * 10000 AS value,
  greatest(a, 1)::DOUBLE * 1000 + b AS second
FROM d
""")
def cn_numerals(t):
    """a missing digit counts as one before small units; the last unit is carried into a large one."""
    p = t("part").select("p_partkey", (F.col("p_partkey") % 10).alias("a"), (F.expr("p_partkey div 10") % 10).alias("b"), (F.col("p_size") % 10).alias("c"))
    glyphs = lambda c: F.translate(c, "0123456789", "零壹贰叁肆伍陆柒捌玖")
    s = lambda c: F.col(c).cast("string")
    p = p.withColumn("numeral", glyphs(F.concat(s("a"), F.lit("佰"), s("b"), F.lit("拾"), s("c"), F.lit("万"))))
    return p.select("p_partkey", "numeral", cn_numeral(F.col("numeral")).alias("value"), cn_numeral(glyphs(F.concat(s("a"), F.lit("仟"), s("b")))).alias("second"))


def order_grids(t) -> DataFrame:
    """One table an order: label, quantity, price (in brackets for returned goods) and a total that is wrong in
    third lines."""
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    price = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), money(x), F.lit(")"))).otherwise(money(x))
    total = q + F.when(F.col("l_returnflag") == "R", -x).otherwise(x) + F.when(F.col("l_linenumber") == 3, 50000).otherwise(0)
    shown = F.when(total < 0, F.concat(F.lit("("), money(-total), F.lit(")"))).otherwise(money(total))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", x.alias("x"), q.alias("q"), F.array(F.concat("l_returnflag", "l_linestatus"), money(q), price, shown).alias("cells"))
    listed = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("r"))
    head = F.array(*[F.lit(c) for c in ("项目", "数量", "单价", "合计")])
    return listed.select("l_orderkey", F.concat(F.array(head), F.transform("r", lambda r: r["cells"])).alias("grid"))


#: Cells, checks, anomalies and scores of the same tables from the numbers.
_ORDERS = """
rows_ AS (
  SELECT l_orderkey, l_returnflag, l_linenumber, l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS x,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag || l_linestatus) - 1 AS row,
    count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem
), totals AS (SELECT *, round(q + x + CASE WHEN l_linenumber = 3 THEN 50000 ELSE 0 END, 2) AS total FROM rows_),
checks AS (
  SELECT l_orderkey, row, round(q + x, 4) AS expected, round(total, 4) AS actual, round(abs(q + x - total), 4) AS diff,
    abs(q + x - total) <= greatest(abs(q + x) * 0.02, 1.0) AS passed
  FROM totals WHERE n > 2
), vals AS (
  SELECT l_orderkey, row, 1 AS col, q AS v FROM totals UNION ALL SELECT l_orderkey, row, 2, x FROM totals UNION ALL SELECT l_orderkey, row, 3, total FROM totals
), stats AS (
  SELECT l_orderkey, avg(v) AS mean, stddev_pop(v) AS std, count(*) FILTER (v > 0) AS pos, count(*) FILTER (v < 0) AS neg FROM vals GROUP BY l_orderkey
), flags AS (
  SELECT l_orderkey, row, col, v AS value FROM vals JOIN stats USING (l_orderkey)
  WHERE pos > 0 AND neg > 0 AND (CASE WHEN neg < pos THEN v < 0 ELSE v > 0 END) AND abs(v) > abs(mean) * 0.1
), scores AS (
  SELECT c.l_orderkey, c.row, c.col,
    round((CASE WHEN c.col = 0 THEN 0.2 ELSE 1.0 END) * (CASE WHEN f.value IS NOT NULL THEN 0.6 ELSE 1.0 END) * (CASE WHEN k.passed = false THEN 0.85 ELSE 1.0 END), 3)::DOUBLE AS score,
    CASE WHEN f.value IS NOT NULL THEN 'anomaly_flagged' WHEN c.col = 0 THEN 'numeric_parse_issue' WHEN k.passed = false THEN 'row_sum_failed' ELSE '' END AS reason
  FROM (SELECT l_orderkey, row, 0 AS col FROM totals UNION ALL SELECT l_orderkey, row, col FROM vals) c
  LEFT JOIN flags f USING (l_orderkey, row, col) LEFT JOIN checks k ON k.l_orderkey = c.l_orderkey AND k.row = c.row
)
"""


def told(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row an element.  Outer, so that no filter on the array's size is pushed below, where it would repeat all that
    makes the array."""
    return df.select(key, F.inline_outer(column)).where("row is not null")


def parsed_orders(t) -> DataFrame:
    return tables.parse_tables(order_grids(t))


@query(f"WITH {_ORDERS} SELECT l_orderkey, row::INT AS row, expected, actual, diff, passed FROM checks")
def row_sum_check(t):
    """Rows against their totals."""
    return told(parsed_orders(t), "l_orderkey", "row_sum_checks")


@query(f"WITH {_ORDERS} SELECT l_orderkey, row::INT AS row, col::INT AS col, round(value, 2) AS value, 'sign_mismatch' AS reason FROM flags")
def sign_mismatch(t):
    """A5: values of the rarer sign."""
    return told(parsed_orders(t), "l_orderkey", "anomaly_flags").select("l_orderkey", "row", "col", F.round("value", 2).alias("value"), "reason")


@query(f"WITH {_ORDERS} SELECT l_orderkey, row::INT AS row, col::INT AS col, score, reason FROM scores")
def cell_confidence(t):
    """A score and a reason for each cell."""
    return told(parsed_orders(t), "l_orderkey", "confidence_scores")


@query(f"""
WITH {_ORDERS} SELECT l_orderkey, round(sum(round(score * 1000)) / count(*)) / 1000 AS table_confidence, count(DISTINCT row)::INT AS num_rows, 4 AS num_cols, 'generic' AS type FROM scores GROUP BY l_orderkey
""")
def table_confidence(t):
    """The whole treatment of a table."""
    return parsed_orders(t).select("l_orderkey", "table_confidence", "num_rows", "num_cols", "type")


@query(f"""
WITH {_ORDERS} SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS tables_checked, count(*) AS total_checks,
  count(*) FILTER (NOT passed) AS total_failures, count(*) FILTER (NOT passed) = 0 AS overall_pass FROM checks
""")
def verification_summary(t):
    """A7."""
    out = tables.verification_summary(parsed_orders(t))
    return out.select("tables_checked", F.col("total_checks").cast("long").alias("total_checks"), F.col("total_failures").cast("long").alias("total_failures"), "overall_pass")


@query("""
WITH o AS (
  SELECT o_custkey, o_orderkey, o_totalprice AS cur, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base FROM orders
), p AS (
  SELECT *, (cur - base) / base * 100 AS expected, round((cur - base) / base * 100 + CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE 0 END, 1) AS told,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row FROM o WHERE base IS NOT NULL
)
SELECT o_custkey, row::INT AS row, base AS base_value, cur AS current_value, round(expected, 2) AS expected_pct,
  abs(expected - abs(told)) <= greatest(abs(expected) * 0.05, 0.5) AS passed FROM p
""")
def percentage_check(t):
    """A3: growth that rows state against the one their values have (a stated minus is read twice)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t("orders").withColumn("base", F.lag("o_totalprice").over(w)).where("base is not null")
    stated = F.round((F.col("o_totalprice") - F.col("base")) / F.col("base") * 100 + F.when(F.col("o_orderkey") % 4 == 0, 7).otherwise(0), 1)
    row = F.array(F.lit("同比增长"), money(F.col("base")), money(F.col("o_totalprice")), F.concat(F.format_number(stated.cast("decimal(18,1)"), 1), F.lit("%")))
    grids = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("r"))
    head = F.array(F.array(*[F.lit(c) for c in ("项目", "上期", "本期", "比率")]))
    out = tables.parse_tables(grids.select("o_custkey", F.concat(head, F.transform("r", lambda x: x["r"])).alias("grid")))
    return told(out, "o_custkey", "percentage_checks").select("o_custkey", "row", "base_value", "current_value", "expected_pct", "passed")


@query("""
WITH v AS (SELECT c_nationkey, c_custkey, round(CASE WHEN c_custkey % 250 = 0 THEN c_acctbal * 100 ELSE c_acctbal END, 2) AS v FROM customer),
s AS (SELECT c_nationkey, avg(abs(v)) AS m, stddev_pop(abs(v)) AS d FROM v GROUP BY c_nationkey)
SELECT c_nationkey, abs(v) AS value, round(abs(abs(v) - m) / d, 1) AS z_score FROM v JOIN s USING (c_nationkey) WHERE abs(abs(v) - m) / d > 5
""")
def anomaly_zscore(t):
    """A4: values five deviations off."""
    v = F.round(F.when(F.col("c_custkey") % 250 == 0, F.col("c_acctbal") * 100).otherwise(F.col("c_acctbal")), 2)
    grids = t("customer").where("c_nationkey is not null").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", F.array(F.lit("name"), money(F.abs(v))).alias("r")))).alias("r"))
    out = tables.parse_tables(grids.select("c_nationkey", F.concat(F.array(F.array(F.lit("项目"), F.lit("金额"))), F.transform("r", lambda x: x["r"])).alias("grid")))
    return told(out, "c_nationkey", "anomaly_flags").where("reason = 'extreme_value'").select("c_nationkey", "value", F.round("deviations", 1).alias("z_score"))


_WORDS = ("资产总计", "货币资金", "净利润", "管理费用", "投资活动", "前期差错更正", "数量", "单价")


@query(f"""
WITH w AS (SELECT p_brand, p_size, ({list(_WORDS)})[(p_partkey % 8 + 1)::INT] AS word FROM part),
s AS (SELECT p_brand, p_size, count(DISTINCT word) FILTER (word IN ('资产总计', '货币资金')) AS b, count(DISTINCT word) FILTER (word IN ('净利润', '管理费用')) AS i,
  count(DISTINCT word) FILTER (word = '投资活动') AS c, count(DISTINCT word) FILTER (word = '前期差错更正') AS e FROM w GROUP BY ALL)
SELECT p_brand, p_size, CASE WHEN greatest(b, i, c, e) = 0 THEN 'generic' WHEN b = greatest(b, i, c, e) THEN 'balance_sheet' WHEN i = greatest(b, i, c, e) THEN 'income_statement'
  WHEN c = greatest(b, i, c, e) THEN 'cash_flow' ELSE 'equity_change' END AS type FROM s
""")
def table_classify(t):
    """The kind of a table by its words."""
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    grids = t("part").groupBy("p_brand", "p_size").agg(F.array(F.collect_list(word)).alias("grid"))
    return grids.select("p_brand", "p_size", tables.classify(F.col("grid")).alias("type"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2 ELSE 1 END AS n_headers, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS n_rows,
  CASE c_custkey % 4 WHEN 2 THEN '1.0' WHEN 0 THEN '金额' WHEN 1 THEN '金额' ELSE '金额' END AS first_head
FROM customer
""")
def header_split(t):
    """One or two header rows, none at all, a blank first row (which leaves the header in the data)."""
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    head, b = row("项目", "金额"), row("1.5", money(F.col("c_acctbal")))
    k = F.col("c_custkey") % 4
    num = row("2.0", "1.0")
    grid = F.when(k == 0, F.array(head, row("期间", "年初"), num, b)).when(k == 1, F.array(head, num, b)).when(k == 2, F.array(num, b)).otherwise(F.array(row("", ""), head, num))
    df = t("customer").select("c_custkey", grid.alias("grid"))
    out = tables.split_headers(df.withColumn("num", tables.numeric_grid(F.col("grid"))))
    return out.select("c_custkey", F.size("headers").alias("n_headers"), F.size("rows").alias("n_rows"), F.get(F.get("headers", F.lit(0)), F.lit(1)).alias("first_head"))


@query("""
WITH r AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_discount > 0.06) AS c3, count(*) FILTER (l_discount > 0.03) AS c2, count(*) FILTER (l_tax > 0.05) AS c1 FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN c3 >= n * 0.3 THEN 3 WHEN c2 >= n * 0.3 THEN 2 WHEN c1 >= n * 0.3 THEN 1 END AS last_col FROM r
""")
def last_numeric_col(t):
    """A2: the last column with numbers in three of ten rows."""
    some = lambda test: F.when(test, money(F.col("l_extendedprice"))).otherwise("")
    row = F.array(F.lit("甲"), some(F.col("l_tax") > 0.05), some(F.col("l_discount") > 0.03), some(F.col("l_discount") > 0.06))
    grids = t("lineitem").groupBy("l_suppkey").agg(F.collect_list(row).alias("grid"))
    # numbers are read once, in a column of their own
    return grids.withColumn("num", tables.numeric_grid(F.col("grid"))).select("l_suppkey", tables.last_numeric_col(F.col("num")).alias("last_col"))


# -- grids ------------------------------------------------------------------------------------------


def nation_grids(t, name: Column | None = None) -> DataFrame:
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), name if name is not None else F.col("n_name")).alias("r"))
    return t("nation").groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note"))), F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"])).alias("grid"))


_MD = "'| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey)"


@query(f"SELECT n_regionkey, {_MD} AS markdown FROM nation GROUP BY n_regionkey")
def grid_to_markdown(t):
    """Short rows are filled up."""
    return nation_grids(t).select("n_regionkey", G.grid_to_markdown(F.col("grid")).alias("markdown"))


@query("""
SELECT n_regionkey, 'key,name,note' || chr(13) || chr(10) || string_agg(n_nationkey || ',' || CASE WHEN n_nationkey % 2 = 0 THEN chr(34) || n_name || ', ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) ELSE n_name END || chr(13) || chr(10), '' ORDER BY n_nationkey) AS csv
FROM nation GROUP BY n_regionkey
""")
def grid_to_csv(t):
    """Quotes only where they are needed."""
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(', "x"'))).otherwise(F.col("n_name"))
    return nation_grids(t, name).select("n_regionkey", G.grid_to_csv(F.col("grid")).alias("csv"))


@query("""
SELECT n_regionkey, pos::INT AS row, a, b, c FROM (
  SELECT n_regionkey, 0 AS pos, 'key' AS a, 'name' AS b, 'note' AS c FROM nation GROUP BY n_regionkey
  UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), n_nationkey::VARCHAR, n_name, '' FROM nation)
""")
def markdown_round_trip(t):
    """what the Markdown of a grid says, by the lenient and by the strict reading."""
    md = nation_grids(t).select("n_regionkey", G.grid_to_markdown(F.col("grid")).alias("m"))
    # the lenient reading drops one empty cell at the end, and fills it up again
    lenient = md.select("n_regionkey", F.posexplode(G.markdown_to_grid(F.concat(F.lit(" text\n"), "m"))).alias("row", "r"))
    strict = md.select("n_regionkey", F.posexplode(G.markdown_rows(F.col("m"))).alias("row", "s"))
    both = lenient.join(strict, ["n_regionkey", "row"])
    return both.select("n_regionkey", "row", F.get("r", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"), F.get("s", F.lit(2)).alias("c"))


@query("""
SELECT c_custkey, k::INT AS kind, 2 AS n_rows, CASE k WHEN 0 THEN 3 ELSE 2 END AS n_cols, c_name AS first, CASE k WHEN 0 THEN 'x' ELSE '' END AS last
FROM customer, (SELECT unnest([0, 1, 2]) AS k)
""")
def text_to_grid(t):
    """tabs, bars or blanks, as the first line has them."""
    kind = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("kind")
    n, m = F.col("c_name"), F.col("c_mktsegment")
    text = F.when(F.col("kind") == 0, F.concat(n, F.lit("\t"), m, F.lit("\n\n  a\tb\tx "))).when(F.col("kind") == 1, F.concat(F.lit("| "), n, F.lit(" | "), m, F.lit(" |\n|z|"))).otherwise(F.concat(n, F.lit("   "), m, F.lit("\nq r")))
    df = t("customer").select("c_custkey", "c_name", "c_mktsegment", kind)
    df = df.withColumn("g", G.text_to_grid(text))
    return df.select("c_custkey", "kind", F.size("g").alias("n_rows"), G.width(F.col("g")).alias("n_cols"), F.get(F.get("g", F.lit(0)), F.lit(0)).alias("first"), F.element_at(F.get("g", F.lit(1)), -1).alias("last"))


@query("""
SELECT n_nationkey, 0 AS row, [n_name, n_name, 'r' || n_regionkey]::VARCHAR AS cells FROM nation
UNION ALL SELECT n_nationkey, 1, ['a & b', 'x', 'r' || n_regionkey]::VARCHAR FROM nation
""")
def html_grid(t):
    """Spans filled in, references resolved, white space folded."""
    src = F.concat(F.lit("<table><tr><td colspan=2>"), "n_name", F.lit("</td><td rowspan='2'> r"), F.col("n_regionkey").cast("string"), F.lit("\n</td></tr><tr><th>a  &amp;\n b</th><td>x</td></tr></table>"))
    df = t("nation").select("n_nationkey", F.posexplode(G.html_to_grid(src)).alias("row", "r"))
    return df.select("n_nationkey", "row", F.concat(F.lit("["), F.array_join("r", ", "), F.lit("]")).alias("cells"))


@query()
def html_blocks(t):
    """Titles, headings, paragraphs and items, tables, images of web pages."""
    return files.html_blocks(t("pages"), "page_id").select("page_id", "pos", "type", "text", "markdown")


@query("""
SELECT n_nationkey, 0 AS row_start, 0 AS col_start, 1 AS row_end, 2 AS col_end FROM nation
UNION ALL SELECT n_nationkey, 1, 1, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END, 3 FROM nation
""")
def merged_ranges(t):
    """Equal cells across, and down while the whole stretch repeats; columns alone don't count."""
    lit = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    n = F.col("n_name")
    grid = F.array(lit(n, n, "c"), lit("d", "e", "e"), F.when(F.col("n_nationkey") % 2 == 0, lit("d", "e", "e")).otherwise(lit("d", "e", "f")))
    return t("nation").select("n_nationkey", F.inline(G.merged_ranges(grid)))


# -- merging ----------------------------------------------------------------------------------------


@query(r"""
WITH chunks AS (
  SELECT doc_id, k::INT AS pos, substr(text, k * 180 + 1, 180) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 179) // 180)) AS k FROM documents)
), ends AS (
  SELECT *, lag(text) OVER w AS prev FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), marks AS (
  SELECT *, right(rtrim(prev, E' \t\n\r'), 1) AS e, left(ltrim(text, E' \t\n\r'), 1) AS b, regexp_extract(rtrim(prev, E' \t\n\r'), '(\S+)$', 1) AS last_word,
    regexp_matches(ltrim(text, E' \t\n\r'), '^[#0-9]+[.、]') AS heading FROM ends
), joins AS (
  SELECT *, coalesce(e <> '' AND b <> '' AND (
      (length(last_word) <= 2 AND regexp_matches(right(last_word, 1), '^\p{L}$'))
      OR (NOT e IN ('。','！','？','；','：','…','.','!','?',';',':','）',')','】','》','」','』','"','''') AND NOT b IN ('。','！','？','；','：','…','.','!','?',';',':') AND NOT heading
          AND (regexp_matches(b, '^(\p{Ll}|\p{Nd})$') OR unicode(b) > 19968))), false) AS goes_on
  FROM marks
), chains AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM joins),
glued AS (
  SELECT *, CASE WHEN NOT goes_on THEN '' WHEN prev LIKE '% ' OR text LIKE ' %' THEN ' ' WHEN regexp_matches(e, '^\p{L}$') AND regexp_matches(b, '^\p{L}$') THEN ' ' ELSE '' END AS glue FROM chains
)
SELECT doc_id, min(pos)::INT AS pos, count(*)::INT AS chain_length, length(string_agg(glue || text, '' ORDER BY pos))::INT AS chars, md5(string_agg(glue || text, '' ORDER BY pos)) AS digest
FROM glued GROUP BY doc_id, grp
""")
def text_merge_chains(t):
    """M6, M7: paragraphs that page breaks every 180 characters have torn."""
    docs = t("documents").where("length(text) > 0")
    pieces = F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,180}"), F.lit(0))).alias("pos", "text")
    blocks = docs.select("doc_id", pieces).select("doc_id", "pos", F.col("pos").alias("page_idx"), F.lit("text").alias("type"), "text")
    out = merge.merge_texts(blocks)
    return out.select("doc_id", "pos", "chain_length", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def fragments(t) -> DataFrame:
    """Orders' lines, three on a page; the header is repeated on every page of even orders; pages of every fifth
    order are not adjacent."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = t("lineitem").withColumn("i", F.row_number().over(order) - 1).withColumn("pos", F.expr("i div 3").cast("int"))
    row = F.struct("i", F.array(F.concat("l_returnflag", "l_linestatus"), money(F.col("l_quantity")), money(F.col("l_extendedprice"))).alias("c"))
    head = F.array(F.array(F.lit("项目"), F.lit("数量"), F.lit("单价")))
    g = lines.groupBy(F.col("l_orderkey").alias("doc_id"), "pos").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["c"]).alias("r"))
    data = F.when((F.col("pos") == 0) | (F.col("doc_id") % 2 == 0), F.concat(head, F.col("r"))).otherwise(F.col("r"))
    page = F.when(F.col("doc_id") % 5 == 0, F.col("pos") * 2).otherwise(F.col("pos"))
    return g.select("doc_id", "pos", page.alias("page_idx"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), data.alias("data"), F.lit(None).cast("int").alias("cols"))


_FRAGMENTS = """
WITH r AS (
  SELECT l_orderkey AS doc_id, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1) // 3)::INT AS pos FROM lineitem
), g AS (SELECT doc_id, pos, count(*) + CASE WHEN pos = 0 OR doc_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM r GROUP BY doc_id, pos),
m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN pos ELSE 0 END AS head, pos, n FROM g)
"""


@query(_FRAGMENTS + "SELECT doc_id, pos, CASE WHEN doc_id % 5 = 0 THEN pos + 1 ELSE 1 END::BIGINT AS grp FROM m")
def table_merge_groups(t):
    """Which fragments belong together."""
    return merge.table_groups(fragments(t), exact=False).select("doc_id", "pos", "grp")


@query(
    """
WITH r AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS i,
    concat_ws('|', l_returnflag || l_linestatus, format('{:,.2f}', l_quantity), format('{:,.2f}', l_extendedprice)) AS cells FROM lineitem
), m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN i // 3 ELSE 0 END::INT AS pos, i, cells FROM r),
g AS (SELECT doc_id, pos, count(DISTINCT i // 3)::INT AS fragments, count(*) AS n, string_agg(cells, chr(10) ORDER BY i) AS body, pos = 0 OR doc_id % 2 = 0 AS headed FROM m GROUP BY doc_id, pos)
SELECT doc_id, pos, fragments, (n + headed::INT)::INT AS rows, 3 AS cols, CASE WHEN fragments > 1 THEN 0.85::DOUBLE END AS confidence, md5(CASE WHEN headed THEN '项目|数量|单价' || chr(10) ELSE '' END || body) AS cells FROM g
"""
)
def merged_table(t):
    """M4, M5: fragments folded into tables, without their repeated headers (similarity by Python, where needed)."""
    cells = F.md5(F.array_join(F.transform("data", lambda r: F.array_join(r, "|")), "\n"))
    return merge.merge_tables(fragments(t)).select("doc_id", "pos", "fragments", "rows", "cols", "confidence", cells.alias("cells"))


# -- entities ---------------------------------------------------------------------------------------


def sentences(t) -> DataFrame:
    """Two blocks a customer, with a company, amounts, a date and expressions that refer to them."""
    k = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("华星", "北辰", "东方")]), (k % 3 + 1).cast("int")), F.lit("科技有限公司"))
    amount = F.concat(money(F.abs(F.col("c_acctbal"))), F.lit("万元"))
    first = F.concat(name, F.lit("，于2024年"), (k % 12 + 1).cast("string"), F.lit("月签约，收入"), amount, F.lit("，占"), (k % 90 + 10).cast("string"), F.lit(".5%，该公司确认，上述金额无误"))
    second = F.concat(name, F.lit("；同期：支出"), (k % 7 + 1).cast("string"), F.lit("亿元。Mr. Smith 出席"))
    blocks = t("customer").select(k.alias("doc_id"), F.posexplode(F.array(first, second)).alias("pos", "text"))
    return blocks.select("doc_id", "pos", F.col("pos").alias("page_idx"), F.lit("text").alias("type"), "text")


_SENTENCES = """
s AS (
  SELECT c_custkey AS doc_id, (['华星', '北辰', '东方'])[(c_custkey % 3 + 1)::INT] || '科技有限公司' AS name, format('{:,.2f}万元', abs(c_acctbal)) AS amount,
    '2024年' || (c_custkey % 12 + 1) || '月' AS day, (c_custkey % 90 + 10) || '.5%' AS share, (c_custkey % 7 + 1) || '亿元' AS cost FROM customer
), blocks AS (
  SELECT doc_id, 0 AS pos, name || '，于' || day || '签约，收入' || amount || '，占' || share || '，该公司确认，上述金额无误' AS text FROM s
  UNION ALL SELECT doc_id, 1, name || '；同期：支出' || cost || '。Mr. Smith 出席' FROM s
)"""
_MENTIONS = " UNION ALL ".join(f"SELECT doc_id, pos, '{c}' AS category, regexp_extract_all(text, '{p}', 1) AS found FROM blocks" for c, p in ENTITIES)


@query(f"""
WITH {_SENTENCES}, m AS (SELECT doc_id, pos, category, unnest(found) AS text, generate_subscripts(found, 1) AS i FROM ({_MENTIONS})),
f AS (SELECT doc_id, category, trim(text) AS text, min(pos * 1000 + i) AS nth FROM m WHERE length(trim(text)) >= 2 GROUP BY ALL)
SELECT doc_id, category, text, row_number() OVER (PARTITION BY doc_id, category ORDER BY nth) - 1 AS ord FROM f
""")
def entity_registry(t):
    """Entities of a document by category, each once."""
    return entities.entity_registry(sentences(t)).select("doc_id", "category", "text", F.col("ord").cast("long").alias("ord"))


@query(f"""
WITH {_SENTENCES}
SELECT doc_id, 0 AS pos, '该公司' AS reference, '该公司' AS resolved_entity, 0.7::DOUBLE AS confidence, 'rule' AS method FROM s
UNION ALL SELECT doc_id, 0, '上述金额', amount, 0.65, 'rule' FROM s
UNION ALL SELECT doc_id, 1, '同期', day, 0.6, 'rule' FROM s
""")
def reference_resolution(t):
    """What expressions refer to.  The entity named last before an expression's end is nearest: for a
    company that is the expression itself, which its pattern takes for a company too."""
    return entities.resolve_references(sentences(t)).select("doc_id", "pos", "reference", "resolved_entity", "confidence", "method")


@query(f"""
WITH {_SENTENCES}
SELECT doc_id, 0 AS pos, '该公司' AS reference, (instr(text, '该公司') - 1)::INT AS place FROM blocks WHERE pos = 0
UNION ALL SELECT doc_id, 0, '上述金额', (instr(text, '上述金额') - 1)::INT FROM blocks WHERE pos = 0
UNION ALL SELECT doc_id, 1, '同期', (instr(text, '同期') - 1)::INT FROM blocks WHERE pos = 1
""")
def references_found(t):
    """R2: all expressions with their offsets."""
    return sentences(t).select("doc_id", "pos", F.inline(entities.find_references("text"))).withColumnRenamed("at", "place")


# -- charts and images ------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT event_type, n::VARCHAR AS v, strftime(day, '%Y-%m-%d') AS label, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, dense_rank() OVER (ORDER BY event_type) AS s FROM d),
m AS (SELECT i, arg_min(label, s) AS label, string_agg(s || '=' || v, ',' ORDER BY s) AS vals FROM k GROUP BY i)
SELECT i::INT AS row, label, vals FROM m
""")
def chart_series_table(t):
    """Series of events a day side by side; the label is the first series' that has one there."""
    d = t("events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    one = d.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", F.date_format("day", "yyyy-MM-dd").alias("label"), F.col("n").cast("string").alias("v")))).alias("p"))
    series = F.struct(F.col("event_type").alias("name"), F.transform("p", lambda x: x["label"]).alias("labels"), F.transform("p", lambda x: x["v"]).alias("values"))
    table = one.agg(charts.series_to_table(F.sort_array(F.collect_list(series))).alias("g"))
    rows = table.select(F.posexplode("g").alias("row", "r")).where("row > 0")
    vals = F.array_join(F.filter(F.transform(F.slice("r", F.lit(2), F.size("r") - 1), lambda v, i: F.when(v != "", F.concat((i + 1).cast("string"), F.lit("="), v))), lambda x: x.isNotNull()), ",")
    return rows.select("row", F.get("r", F.lit(0)).alias("label"), vals.alias("vals"))


@query("""
WITH f AS (SELECT p_partkey, p_size % 15 AS h, p_partkey % 13 AS v, (p_partkey % 11) / 100.0 AS e FROM part)
SELECT p_partkey, CASE WHEN h > 10 AND v > 10 AND e > 0.08 THEN 'heatmap' WHEN h > 5 AND v > 2 THEN 'bar_chart' WHEN h > 5 AND v < 2 THEN 'line_chart' WHEN e < 0.03 THEN 'pie_chart'
  WHEN h < 3 AND v < 3 AND e > 0.05 THEN 'scatter_plot' ELSE 'unknown' END AS chart_type,
  (CASE WHEN h > 10 AND v > 10 AND e > 0.08 THEN 0.3 WHEN h > 5 AND v > 2 THEN 0.35 WHEN h > 5 AND v < 2 THEN 0.3 WHEN e < 0.03 THEN 0.25 WHEN h < 3 AND v < 3 AND e > 0.05 THEN 0.25 ELSE 0.1 END)::DOUBLE AS confidence
FROM f
""")
def chart_rule_classify(t):
    """H2: the kind of a chart from its lines."""
    kind = charts.chart_kind(F.col("p_size") % 15, F.col("p_partkey") % 13, (F.col("p_partkey") % 11) / 100.0)
    return t("part").select("p_partkey", kind.alias("k")).select("p_partkey", "k.*")


@query("""
WITH v AS (SELECT item_id, text, unnest([0, 1, 2]) AS p FROM benchmark),
w AS (SELECT item_id, p, CASE p WHEN 0 THEN text WHEN 1 THEN left(text, 2) || '#' || substr(text, 4) ELSE left(text, 4) || '?' || substr(text, 6) || '!' END AS text FROM v),
c AS (SELECT item_id, p, i, substr(text, i, 1) AS c FROM (SELECT item_id, p, text, unnest(range(1, length(text) + 1)) AS i FROM w)),
n AS (SELECT item_id, i, c, count(*) AS n, min(p) AS first FROM c GROUP BY ALL),
b AS (SELECT item_id, i, arg_min(c, -n * 10 + first) AS c, max(n) AS n FROM n GROUP BY item_id, i)
SELECT item_id, string_agg(c, '' ORDER BY i) AS text, round(sum(n / 3.0), 4) AS agreement FROM b GROUP BY item_id
""")
def ocr_vote(t):
    """Three readings, one text."""
    x = F.col("text")
    second = F.concat(F.left(x, F.lit(2)), F.lit("#"), F.substring(x, 4, 1 << 30))
    third = F.concat(F.left(x, F.lit(4)), F.lit("?"), F.substring(x, 6, 1 << 30), F.lit("!"))
    df = t("benchmark").select("item_id", imaging.vote(F.array(x, second, third)).alias("v"))
    return df.select("item_id", "v.text", F.round(F.aggregate("v.confidence", F.lit(0.0), lambda a, c: a + c), 4).alias("agreement"))


@query("""
WITH m AS (SELECT vec_id, vec_id % 200 * 1.0 AS blur, vec_id % 60 * 1.0 AS noise, vec_id % 10 / 20.0 AS con, (vec_id % 9 - 4) / 4.0 AS skew, vec_id % 5 / 1000.0 AS stamp, vec_id % 400 * 1.0 AS dpi FROM embeddings)
SELECT vec_id, list_aggregate(list_filter([CASE WHEN dpi < 200 THEN 'upscale_to_300dpi' END, CASE WHEN stamp >= 0.002 THEN 'stamp_removal' END, CASE WHEN abs(skew) > 0.5 THEN 'deskew_' || format('{:.2f}', skew) || 'deg' END,
  CASE WHEN con < 0.2 THEN 'clahe_contrast' END, CASE WHEN noise > 30 THEN 'denoise' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS steps, blur < 100 AS is_blurry FROM m
""")
def image_thresholds(t):
    """Flags of images, and the filters that follow from them."""
    k = F.col("vec_id")
    m = F.struct(
        (k % 200).cast("double").alias("blur_score"), (k % 60).cast("double").alias("noise_level"), (k % 10 / 20.0).alias("contrast"), ((k % 9 - 4) / 4.0).alias("skew_angle"),
        (k % 5 / 1000.0).alias("stamp_pixel_ratio"), (k % 400).cast("double").alias("estimated_dpi"),
    )
    df = t("embeddings").select("vec_id", m.alias("m")).withColumn("f", imaging.quality_flags())
    steps = F.array_join(imaging.repair_steps(F.col("f"), F.col("m.skew_angle")), ",")
    return df.select("vec_id", F.when(steps != "", steps).alias("steps"), "f.is_blurry")


# -- plans ------------------------------------------------------------------------------------------


def requests(t) -> DataFrame:
    extra = F.element_at(F.array(*[F.lit(x) for x in ("", " 财务报表", " chart of graphs", " 模糊扫描", " export as csv", " table chart 手写", " complete")]), (F.col("conv_id") % 7 + 1).cast("int"))
    pages = (F.col("turn") % 3 + 1).cast("int")
    path = F.concat(F.lit("/in/"), F.col("conv_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".docx")]), (F.col("turn") % 3 + 1).cast("int")))
    return t("conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), extra).alias("request"), pages.alias("pages"), path.alias("path"))


def _sql_any(words, text: str = "lower(request)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_REQUESTS = """
r AS (
  SELECT conv_id, turn, coalesce(text, '') || (['', ' 财务报表', ' chart of graphs', ' 模糊扫描', ' export as csv', ' table chart 手写', ' complete'])[(conv_id % 7 + 1)::INT] AS request,
    (turn % 3 + 1)::INT AS pages, turn % 3 = 1 AS image FROM conversations
)"""
_ASSESSED = f"""
a AS (SELECT *, {_sql_any(ASSESS_WORDS["table"])} AS t, {_sql_any(ASSESS_WORDS["chart"])} AS c, {_sql_any(ASSESS_WORDS["poor"])} AS p, {_sql_any(ASSESS_WORDS["export"])} AS x, pages > 1 AS m FROM r)"""


@query(f"""
WITH {_REQUESTS}, {_ASSESSED}
SELECT conv_id, turn, concat('document_parse', CASE WHEN t THEN ',table_extract,financial_report' END, CASE WHEN c THEN ',chart_analysis' END, CASE WHEN p THEN ',low_quality_ocr' END,
    CASE WHEN m THEN ',cross_page_merge' END, CASE WHEN x THEN ',structured_export' END) AS task_types,
  CASE WHEN t OR p THEN 'hard' ELSE 'medium' END AS difficulty,
  (2 + t::INT * 2 + c::INT + p::INT * 4 + m::INT + x::INT + image::INT)::INT AS estimated_subtasks
FROM a
""")
def task_assess(t):
    """K1, K2: what a request asks for."""
    out = requests(t).withColumn("a", control.assess(F.col("request"), F.col("pages"), file_kind(F.col("path")) == "image"))
    return out.select("conv_id", "turn", F.array_join("a.task_types", ",").alias("task_types"), "a.difficulty", "a.estimated_subtasks")


@query(f"""
WITH {_REQUESTS}, s AS (
  SELECT *, {_sql_any(PLANNER_WORDS["table"])} AS t, {_sql_any(PLANNER_WORDS["chart"])} AS c, {_sql_any(PLANNER_WORDS["poor"])} AS p, {_sql_any(PLANNER_WORDS["thorough"])} AS h FROM r)
SELECT conv_id, turn, concat('document_parse', CASE WHEN t THEN ',table_extract' END, CASE WHEN c THEN ',chart_analysis' END) AS task_types,
  CASE WHEN h OR (t AND c) OR p THEN 'hard' WHEN length(request) < 20 AND NOT t AND NOT c AND NOT p THEN 'easy' ELSE 'medium' END AS difficulty, (3 + t::INT + c::INT)::INT AS estimated_subtasks,
  concat(CASE WHEN p THEN 'preprocess ' END, 'extract ', CASE WHEN t THEN 'table_' || (1 + p::INT) || ' ' END, CASE WHEN c THEN 'chart_' || (1 + p::INT + t::INT) || ' ' END, CASE WHEN pages > 1 THEN 'merge ' END, 'verify') AS plan
FROM s
""")
def task_assess_simple(t):
    """K3, K5: the planner's reading and its plan."""
    out = requests(t).withColumn("a", control.assess_simple(F.col("request")))
    names = F.array_join(F.transform(control.build_subtasks(F.col("a"), F.col("pages")), lambda s: s["name"]), " ")
    return out.select("conv_id", "turn", F.array_join("a.task_types", ",").alias("task_types"), "a.difficulty", "a.estimated_subtasks", names.alias("plan"))


@query(f"""
WITH {_REQUESTS}, {_ASSESSED},
k AS (SELECT conv_id, turn, list_filter([CASE WHEN image THEN 'preprocess' END, 'extract', CASE WHEN t THEN 'table' END, CASE WHEN c THEN 'chart' END, CASE WHEN m THEN 'merge' END, 'verify'], lambda x: x IS NOT NULL) AS s, image FROM a),
u AS (SELECT conv_id, turn, s, image, unnest(s) AS kind, generate_subscripts(s, 1) - 1 AS i FROM k)
SELECT conv_id, turn, i::INT AS i, format('step_{{:03d}}_{{}}', i, kind) AS step_id,
  CASE kind WHEN 'preprocess' THEN 'image_enhancer' WHEN 'extract' THEN 'document_parser' WHEN 'table' THEN 'table_parser' WHEN 'chart' THEN 'chart_analyzer' WHEN 'merge' THEN 'cross_page_merger' ELSE 'verifier' END AS tool_name,
  (CASE kind WHEN 'preprocess' THEN 0 WHEN 'extract' THEN image::INT WHEN 'verify' THEN i ELSE 1 END)::INT AS n_dependencies
FROM u
""")
def task_plan(t):
    """Steps and what they wait for."""
    out = requests(t).withColumn("a", control.assess(F.col("request"), F.col("pages"), file_kind(F.col("path")) == "image"))
    steps = out.select("conv_id", "turn", F.posexplode(control.build_plan(F.col("a"), F.col("pages"), F.col("path"))).alias("i", "s"))
    return steps.select("conv_id", "turn", "i", "s.step_id", "s.tool_name", F.size("s.dependencies").alias("n_dependencies"))


@query(f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, doc_id % 120 AS pages, doc_id % 400 AS blocks, doc_id % 9 AS tables, doc_id % 14 AS images, doc_id % 5 AS steps, doc_id % 4 AS done,
  coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' 表格' ELSE ' merge' END AS request FROM documents)
SELECT doc_id, round(greatest(0, least(1,
  CASE WHEN chars > 0 THEN 0.15 + least(0.05, pages * 0.001) + least(0.05, blocks * 0.0002) + CASE WHEN chars > 100 THEN least(0.05, chars / 200000) ELSE 0 END ELSE 0 END
  + CASE WHEN steps > 0 THEN 0.3 * least(done, steps) / steps ELSE 0.1 END
  + CASE WHEN {_sql_any(VERIFY_WORDS["tables"])} AND tables > 0 THEN 0.1 WHEN {_sql_any(VERIFY_WORDS["merge"])} AND doc_id % 2 = 0 THEN 0.05 WHEN chars > 0 THEN 0.1 ELSE 0 END
  + CASE WHEN {_sql_any(VERIFY_WORDS["tables"])} AND tables > 0 AND {_sql_any(VERIFY_WORDS["merge"])} AND doc_id % 2 = 0 THEN 0.05 ELSE 0 END
  + least(0.1, tables * 0.02) + least(0.05, images * 0.005) + least(0.05, blocks * 0.0001))), 6)::DOUBLE AS quality_score FROM d
""")
def quality_score(t):
    """How good a result is."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    request = F.concat(text, F.when(k % 3 == 0, " 表格").otherwise(" merge"))
    steps = k % 5
    score = control.quality_score(request, F.length(text), k % 120, k % 400, k % 9, k % 14, steps, F.least(k % 4, steps), merged=(k % 2 == 0))
    return t("documents").select("doc_id", F.round(score, 6).alias("quality_score"))


@query("""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, doc_id % 120 AS pages, doc_id % 400 AS blocks, doc_id % 9 AS tables, doc_id % 14 AS images, doc_id % 3 AS failed FROM documents),
s AS (SELECT doc_id, greatest(0e0, least(1e0,
  CASE WHEN blocks > 0 OR chars > 0 THEN 15e-2 + CASE WHEN chars > 100 THEN least(1e-1, chars / 200000) ELSE 0e0 END + least(5e-2, blocks * 2e-4) ELSE 0e0 END
  + CASE WHEN pages > 0 AND chars >= pages * 10 THEN least(15e-2, pages * 2e-3) ELSE 0e0 END + least(1e-1, tables * 2e-2) + least(5e-2, images * 5e-3) - failed * 5e-2)) AS x FROM d)
SELECT doc_id, round(x::VARCHAR::DECIMAL(30, 20), 2)::DOUBLE AS quality_score, x >= 0.7 AS passed FROM s
""")
def builtin_verify(t):
    """K8: the verifier tool's score, rounded by it as it is written out, and its verdict."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    verdict = control.builtin_score(F.length(text), k % 120, k % 400, k % 9, k % 14, k % 3)
    return t("documents").select("doc_id", verdict.alias("v")).select("doc_id", "v.quality_score", "v.passed")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 6 = 0 THEN 'error_handler' WHEN event_id % 5 >= 3 THEN 'verify_result' ELSE 'execute_step' END AS after_execute,
  CASE WHEN event_id % 6 = 1 THEN 'format_output' ELSE 'execute_step' END AS after_error,
  CASE WHEN event_id % 4 = 0 AND event_id % 3 < 2 AND event_id % 2 + event_id % 5 > 0 THEN 'prepare_replan' ELSE 'format_output' END AS after_verify FROM events
""")
def route_next(t):
    """K9: which node follows."""
    k = F.col("event_id")
    status = F.when((F.col("event_type") == "error") | (k % 6 == 0), "error").when(k % 6 == 1, "failed").otherwise("executing")
    return t("events").select(
        "event_id",
        control.after_execute(status, k % 5, F.lit(3)).alias("after_execute"),
        control.after_error(F.when(k % 6 == 1, "failed").otherwise("retrying")).alias("after_error"),
        control.after_verify(k % 4 != 0, k % 3, k % 2 + k % 5).alias("after_verify"),
    )


@query("""
SELECT c_custkey, (c_custkey % 3)::INT AS target, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'completed' END, CASE WHEN c_custkey % 3 = 1 THEN 'pending' ELSE 'failed' END, CASE WHEN c_custkey % 3 = 2 THEN 'pending' ELSE 'skipped' END) AS statuses
FROM customer
""")
def replan_steps(t):
    """Steps that are done again."""
    step = lambda i, s: F.struct(F.lit(f"s{i}").alias("step_id"), F.lit(s).alias("status"), F.lit(2).alias("retry_count"))
    steps = F.array(step(0, "completed"), step(1, "failed"), step(2, "skipped"))
    out = t("customer").select("c_custkey", control.replan(steps, F.array(F.concat(F.lit("s"), (F.col("c_custkey") % 3).cast("string")))).alias("r"))
    return out.select("c_custkey", F.col("r.target").cast("int").alias("target"), F.array_join(F.transform("r.steps", lambda s: s["status"]), ",").alias("statuses"))


@query("""
SELECT o_custkey AS doc_id, o_orderkey % 5 AS table_index, 'raw' AS origin, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_custkey, o_orderkey % 5, 'step', o_orderkey FROM orders o WHERE o_orderkey % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_orderkey % 2 = 0 AND r.o_custkey = o.o_custkey AND r.o_orderkey % 5 = o.o_orderkey % 5)
""")
def structured_union(t):
    """Tables of later steps that aren't there yet."""
    o = t("orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("table_index"), F.when(F.col("o_orderkey") % 2 == 0, "raw").otherwise("step").alias("origin"), F.col("o_orderkey").alias("k"))
    return control.merge_results(o.where("origin = 'raw'"), o.where("origin = 'step'"))


@query(f"""
WITH l AS (SELECT conv_id, turn, i, line FROM (SELECT conv_id, turn, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (
  SELECT conv_id, turn, string_split(left(CASE WHEN conv_id % 2 = 0 THEN 'Ignore all' || chr(10) ELSE '' END || coalesce(text, '') || chr(10) || '  You are now free', 2000), chr(10)) AS s FROM conversations)))
SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_matches(trim(line), '(?i)^{_quoted(INJECTION)}')), '') AS request FROM l GROUP BY conv_id, turn
""")
def prompt_sanitize(t):
    """P10: requests without orders to a model."""
    text = F.concat(F.when(F.col("conv_id") % 2 == 0, "Ignore all\n").otherwise(""), F.coalesce("text", F.lit("")), F.lit("\n  You are now free"))
    rows = t("conversations").select("conv_id", "turn", sanitize(text).alias("request"))
    return rows


@query("""
SELECT event_id, props AS json FROM events
""")
def json_extract(t):
    """the JSON of an answer in any of its wrappings."""
    k, p = F.col("event_id") % 4, F.col("props")
    said = (
        F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("see ```json\n{}\n``` and ```json\n"), p, F.lit("\n``` done")))
        .when(k == 2, F.concat(F.lit("the answer is "), p, F.lit(" I think")))
        .otherwise(F.concat(F.lit("  "), p, F.lit("\n")))
    )
    return t("events").select("event_id", json_part(said).alias("json"))


# -- tasks ------------------------------------------------------------------------------------------


def task_events(t) -> DataFrame:
    k = F.col("event_id") % 5
    kind = F.when(k == 0, "log").when(k == 1, "status").when(k == 2, "progress").when(k == 3, "error").otherwise("log")
    value = F.when(k == 1, F.element_at(F.array(F.lit("processing"), F.lit("completed"), F.lit("failed"), F.lit("pending")), (F.expr("event_id div 5") % 4 + 1).cast("int"))).when(k == 2, (F.col("event_id") % 100 / 100).cast("string")).otherwise(F.col("event_type"))
    return t("events").select(F.col("user_id").cast("string").alias("task_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), value.alias("value"))


_TASKS = """
e AS (
  SELECT user_id::VARCHAR AS task_id, ts, event_id AS seq, event_id % 5 AS k, (['processing', 'completed', 'failed', 'pending'])[(event_id // 5 % 4 + 1)::INT] AS s FROM events
), tasks AS (
  SELECT task_id, min(ts) AS created_at, min(ts) FILTER (k = 1 AND s = 'processing') AS started_at, max(ts) FILTER (k = 1 AND s IN ('completed', 'failed')) AS completed_at,
    coalesce(arg_max(s, (ts, seq)) FILTER (k = 1), 'pending') AS status, count(*) FILTER (k IN (0, 4)) AS n_logs, count(*) FILTER (k = 3) AS n_errors FROM e GROUP BY task_id
)"""


@query(f"""
WITH {_TASKS} SELECT task_id, created_at, started_at, completed_at, status, n_logs, n_errors, round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 2) AS duration FROM tasks
""")
def task_latest(t):
    """The state of each task."""
    return tasks.task_states(task_events(t)).select("task_id", "created_at", "started_at", "completed_at", "status", "n_logs", "n_errors", "duration")


@query(f"WITH {_TASKS} SELECT task_id, created_at FROM tasks ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 10")
def task_list_page(t):
    """A page of the newest."""
    return tasks.list_tasks(tasks.task_states(task_events(t)), 20, 10).select("task_id", "created_at")


@query(f"WITH {_TASKS} SELECT task_id, created_at FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 40")
def task_evict(t):
    """The newest stay."""
    return tasks.evict(tasks.task_states(task_events(t)), 40).select("task_id", "created_at")


@query(f"WITH {_TASKS} SELECT task_id, status FROM tasks WHERE completed_at IS NULL OR completed_at >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 5 DAY")
def task_cleanup(t):
    """T5: tasks that ended long ago go."""
    return tasks.clean_up(tasks.task_states(task_events(t)), F.lit("2024-01-29 00:00:00").cast("timestamp"), 5 * 86400).select("task_id", "status")


@query("""
SELECT task_id, seq, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || event_type AS line FROM (
  SELECT user_id::VARCHAR AS task_id, ts, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 5 IN (0, 4)) WHERE r <= 5
""")
def log_tail(t):
    """The last lines of each task."""
    last = tasks.log_tail(task_events(t).where("kind = 'log'"), 5)
    return last.select("task_id", "seq", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "value").alias("line"))


@query("""
WITH l AS (SELECT user_id::VARCHAR AS task_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WHERE event_id % 5 IN (0, 4)),
g AS (SELECT task_id, ts, sum(n) OVER (PARTITION BY task_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM l)
SELECT task_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS idle_at, count(*) AS lines FROM g GROUP BY task_id, s
""")
def log_stream_sessions(t):
    """What a reader of the tail gets until the task is idle."""
    return tasks.log_sessions(task_events(t).where("kind = 'log'"), "6 hours")


# -- sources ----------------------------------------------------------------------------------------


@query("""
SELECT doc_id, (k // 30)::INT AS i, k::INT AS start, least(k + 30, n_chars // 40)::INT AS stop, 'part' || (k // 30) || '_' || (k + 1) || '-' || least(k + 30, n_chars // 40) AS part
FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 40, 30)) AS k FROM documents)
""")
def page_chunks(t):
    """Parts of long documents."""
    pages = F.expr("n_chars div 40")
    return t("documents").select("doc_id", F.posexplode(files.page_ranges(pages, 30)).alias("i", "r")).select("doc_id", "i", "r.*")


@query("""
SELECT o_custkey, o_orderkey, coalesce(sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 11 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_offset FROM orders
""")
def page_offset(t):
    """Pages before each part; failed parts don't count."""
    parts = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 11).alias("pages"))
    return files.join_parts(parts, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "page_offset")


@query(r"""
WITH p AS (SELECT c_custkey, '/in/' || c_name || (['.pdf', '.PNG', '.docx', '.htm', '.txt', ''])[(c_custkey % 6 + 1)::INT] AS path FROM customer)
SELECT c_custkey, (['.pdf', '.png', '.docx', '.htm', '.txt', ''])[(c_custkey % 6 + 1)::INT] AS suffix, (['pdf', 'image', 'office', 'html', NULL, NULL])[(c_custkey % 6 + 1)::INT] AS kind,
  regexp_replace(path, '[^\p{L}\p{N}\-_.]', '_', 'g') AS name FROM p
""")
def file_routes(t):
    """Which files are read, and how their results are named."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".docx", ".htm", ".txt", "")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    df = t("customer").select("c_custkey", F.concat(F.lit("/in/"), "c_name", ext).alias("path"))
    return df.select("c_custkey", suffix(F.col("path")).alias("suffix"), file_kind(F.col("path")).alias("kind"), safe_name(F.col("path")).alias("name"))


@query(r"SELECT page_id, coalesce(regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE '%example.com', false) AS trusted FROM pages")
def trusted_urls(t):
    """Hosts below the one that is allowed."""
    return t("pages").select("page_id", trusted_url(F.col("url"), "example.com").alias("trusted"))


@query("SELECT n_nationkey, 'png' AS ext, n_name AS content FROM nation")
def data_uris(t):
    """Images in the page itself."""
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("n_name").cast("binary")))
    df = t("nation").select("n_nationkey", decode_data_uri(uri).alias("d"))
    return df.select("n_nationkey", "d.ext", F.col("d.data").cast("string").alias("content"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: orders as formatted tables, read, checked and scored without a user-defined function."""
    return parsed_orders(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")).select("l_orderkey", "type", "num_rows", "checks", "failures", "table_confidence")


