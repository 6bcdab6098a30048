"""One table a row: the grid is an array, every check works on it in place, and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import grid_to_csv, grid_to_markdown, html_to_grid, markdown_to_grid, merged_ranges, text_to_grid, width
from ..functions.let import let, let_all
from ..functions.numeric import extract_numeric, strip
from ..functions.vocabulary import FINANCE_WORDS, GROWTH_WORDS, LABEL_PREFIX, PLAIN_AMOUNT, TABLE_WORDS, UNICODE


def numeric_grid(grid: Column, mode: str = "as_coded") -> Column:
    return F.transform(grid, lambda r: F.transform(r, lambda c: extract_numeric(c, mode)))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def choose_grid(html: Column | None = None, data: Column | None = None, text: Column | None = None, markdown: Column | None = None) -> Column:
    """The first source that has something - HTML, cells, text, Markdown; a single empty cell if none does."""
    out = None
    for source, grid in ((html, html_to_grid), (data, lambda x: x), (text, text_to_grid), (markdown, markdown_to_grid)):
        if source is not None:
            has = source.isNotNull() & ((F.size(source) > 0) if source is data else (source != ""))
            out = F.when(has, grid(source)) if out is None else out.when(has, grid(source))
    empty = F.array(F.array(F.lit("")))
    return F.when(F.coalesce(F.size(out), F.lit(0)) > 0, out).otherwise(empty)


def header_rows(grid: Column, num: Column) -> Column:
    """How many rows from the top are headers: fewer than half of the filled cells are numbers.  A blank first row
    is passed over but not counted, so that the data begins one row early; another blank row ends them."""
    labelled = lambda c: strip(c).rlike("^(" + "|".join(LABEL_PREFIX) + ")")

    def state(r: Column, n: Column) -> Column:
        numbers = _count(F.zip_with(r, n, lambda t, c: c["value"].isNotNull() & ~labelled(t)), lambda ok: ok)
        filled = _count(r, lambda c: strip(c) != "")
        kind = lambda f, k: F.when(f == 0, F.lit("blank")).when(k / f < 0.5, F.lit("head")).otherwise(F.lit("data"))
        return let_all(lambda f, k: kind(f, k), f=filled, k=numbers)

    def led(states: Column, lead: Column) -> Column:
        rest = F.slice(states, lead + 1, F.greatest(F.size(states) - lead, F.lit(0)))
        stop = F.array_position(F.transform(rest, lambda s: s != "head"), True)
        return let(F.when(stop == 0, F.size(rest)).otherwise(stop - 1).cast("int"), lambda n: F.struct(lead.alias("lead"), n.alias("n")))

    return let(F.zip_with(grid, num, state), lambda s: let_all(led, states=s, lead=F.when(F.get(s, F.lit(0)) == "blank", 1).otherwise(0)))


def split_headers(df: DataFrame, grid: str = "grid", num: str = "num") -> DataFrame:
    """Adds ``headers``, ``rows`` and ``row_nums`` (numbers of the rows)."""
    g, size = F.col(grid), F.size(grid)
    df = df.withColumn("_h", header_rows(F.col(grid), F.col(num)))
    n = F.col("_h.n")
    tail = lambda x, k: F.slice(x, k + 1, F.greatest(size - k, F.lit(0)))
    # no header: the first row is one; nothing but headers: the first is one, the rest is data
    many = (n > 1) & (size - n <= 0)
    heads = F.when(n == 0, F.slice(g, 1, 1)).when(many, F.slice(g, F.col("_h.lead") + 1, F.lit(1))).otherwise(F.slice(g, F.col("_h.lead") + 1, n))
    below = lambda x: F.when(n == 0, tail(x, F.lit(1))).when(many, F.slice(x, F.col("_h.lead") + 2, n - 1)).otherwise(tail(x, n))
    return df.withColumns({"headers": heads, "rows": below(g), "row_nums": below(F.col(num))}).drop("_h")


def last_numeric_col(nums: Column) -> Column:
    """The rightmost column with numbers in 30 % of the rows at least; null if there is none."""
    has = F.transform(nums, lambda r: F.transform(r, lambda c: c["value"].isNotNull()))
    enough = lambda h: F.filter(F.sequence(F.lit(0), F.greatest(width(h) - 1, F.lit(0))), lambda c: _count(h, lambda r: F.get(r, c)) >= F.greatest(F.size(h) * F.lit(0.3), F.lit(0.5)))
    return let(has, lambda h: F.array_max(enough(h)))


def summable(rows: Column, nums: Column) -> Column:
    """More than half of the filled first cells are no numbers."""
    firsts = F.zip_with(rows, nums, lambda r, n: F.struct((strip(F.get(r, F.lit(0))) != "").alias("filled"), F.get(n, F.lit(0))["value"].alias("v")))
    share = lambda x: _count(x, lambda c: c["v"].isNull()) / F.nullif(F.size(x), F.lit(0))
    return F.coalesce(let(F.filter(firsts, lambda x: x["filled"]), share) > 0.5, F.lit(False))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def with_row_sums(df: DataFrame, rows: str = "rows", nums: str = "row_nums", total: str = "total_col", is_summable: str = "summable") -> DataFrame:
    """Adds ``row_sum_checks``: per row with two numbers beside the total, their sum against the total, within 2 %
    or 1.  In steps of columns, as deeper nests of lambdas take the analyser long."""
    ok = (F.size(rows) > 2) & (width(F.col(nums)) >= 2) & F.col(is_summable) & (F.col(total) > 0)
    others = F.transform(nums, lambda n, i: F.struct(i.alias("row"), F.get(n, F.col(total))["value"].alias("actual"), F.filter(F.transform(n, lambda c, j: F.when(j != F.col(total), c["value"])), lambda v: v.isNotNull()).alias("v")))
    df = df.withColumn("_s", F.when(ok, F.filter(others, lambda s: (F.size(s["v"]) >= 2) & s["actual"].isNotNull())))
    df = df.withColumn("_s", F.transform("_s", lambda s: F.struct(s["row"].alias("row"), s["actual"].alias("actual"), _sum(s["v"]).alias("expected"))))
    check = lambda s: F.struct(
        s["row"].alias("row"), F.round(s["expected"], 4).alias("expected"), F.round(s["actual"], 4).alias("actual"), F.round(F.abs(s["expected"] - s["actual"]), 4).alias("diff"),
        (F.abs(s["expected"] - s["actual"]) <= F.greatest(F.abs(s["expected"]) * 0.02, F.lit(1.0))).alias("passed"),
    )
    empty = F.array().cast("array<struct<row: int, expected: double, actual: double, diff: double, passed: boolean>>")
    return df.withColumn("row_sum_checks", F.coalesce(F.transform("_s", check), empty)).drop("_s")


def percentage_checks(rows: Column, nums: Column) -> Column:
    """Rows on growth: the first percentage against the change between the first two values, within 5 % or 0.5."""

    def made(i: Column, base: Column, now: Column, told: Column) -> Column:
        out = lambda expected: let(F.abs(expected - told), lambda diff: F.struct(
            i.alias("row"), base.alias("base_value"), now.alias("current_value"), told.alias("reported_pct"), F.round(expected, 2).alias("expected_pct"),
            F.round(diff, 2).alias("diff"), (diff <= F.greatest(F.abs(expected) * 0.05, F.lit(0.5))).alias("passed"),
        ))
        return F.when((base != 0) & (now != 0) & told.isNotNull(), let((now - base) / F.abs(base) * 100, out))

    def check(n: Column, i: Column) -> Column:
        plain = F.filter(n, lambda c: c["value"].isNotNull() & ~c["is_percentage"])
        told = F.get(F.filter(n, lambda c: c["value"].isNotNull() & c["is_percentage"]), F.lit(0))["value"]
        return let(plain, lambda p: let_all(lambda base, now, told: made(i, base, now, told), base=F.get(p, F.lit(0))["value"], now=F.get(p, F.lit(1))["value"], told=told))

    growth = F.zip_with(rows, nums, lambda r, n: F.when(F.array_join(r, " ").rlike("|".join(GROWTH_WORDS)), n))
    return F.filter(F.transform(growth, lambda n, i: F.when(n.isNotNull(), check(n, i))), lambda x: x.isNotNull())


def anomaly_flags(nums: Column) -> Column:
    """Values five deviations from the mean of all; else values of the rarer sign that aren't small.  ``z_score`` has two
    places, ``deviations`` is the same unrounded, for callers that want other places: rounding twice moves x.x45 up."""
    cells = F.flatten(F.transform(nums, lambda r, i: F.transform(r, lambda c, j: F.struct(i.alias("row"), j.alias("col"), F.when(~c["is_percentage"], c["value"]).alias("value")))))

    def with_mean(cells: Column) -> Column:
        return let_all(with_spread, cells=cells, mean=_sum(F.transform(cells, lambda c: c["value"])) / F.nullif(F.size(cells), F.lit(0)))

    def with_spread(cells: Column, mean: Column) -> Column:
        std = F.sqrt(_sum(F.transform(cells, lambda c: (c["value"] - mean) * (c["value"] - mean))) / F.nullif(F.size(cells), F.lit(0)))
        return let_all(flags, cells=cells, mean=mean, std=F.nullif(std, F.lit(0.0)), pos=_count(cells, lambda c: c["value"] > 0), neg=_count(cells, lambda c: c["value"] < 0))

    def flags(cells: Column, mean: Column, std: Column, pos: Column, neg: Column) -> Column:
        def flag(c: Column, z: Column) -> Column:
            rare = F.when(neg < pos, c["value"] < 0).otherwise(c["value"] > 0) & (pos > 0) & (neg > 0) & (F.abs(c["value"]) > F.abs(mean) * 0.1)
            reason = F.when(z > 5, "extreme_value").when(rare, "sign_mismatch")
            far = F.when(z > 5, z)
            return F.struct(c["row"].alias("row"), c["col"].alias("col"), c["value"].alias("value"), F.round(far, 2).alias("z_score"), reason.alias("reason"), far.alias("deviations"))

        return F.filter(F.transform(cells, lambda c: let(F.abs(c["value"] - mean) / std, lambda z: flag(c, z))), lambda f: f["reason"].isNotNull())

    return let(F.filter(cells, lambda c: c["value"].isNotNull()), with_mean)


def cell_confidence(rows: Column, nums: Column, failed: Column, odd: Column) -> Column:
    """Per cell row, col, score and reason; ``failed``: rows whose sum is wrong, ``odd``: cells that are anomalies."""

    def cell(text: Column, conf: Column, i: Column, j: Column) -> Column:
        empty, poor = strip(text) == "", conf < 1.0
        flagged, row_failed = F.array_contains(odd, F.struct(i.alias("row"), j.alias("col"))), F.array_contains(failed, i)
        mixed = text.rlike("[一-鿿]") & text.rlike("[0-9]") & ~strip(text).rlike(UNICODE + PLAIN_AMOUNT)
        rate = F.when(poor, conf).otherwise(F.lit(1.0)) * F.when(flagged, 0.6).otherwise(1.0) * F.when(row_failed, 0.85).otherwise(1.0) * F.when(mixed, 0.9).otherwise(1.0)
        reason = F.when(empty, "empty_cell").when(flagged, "anomaly_flagged").when(poor, "numeric_parse_issue").when(row_failed, "row_sum_failed").when(mixed, "mixed_script").otherwise("")
        return F.struct(i.alias("row"), j.alias("col"), F.round(F.when(empty, F.lit(0.7)).otherwise(rate), 3).alias("score"), reason.alias("reason"))

    return F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda t, j: cell(t, F.get(F.get(nums, i), j)["confidence"], i, j))))


def table_confidence(scores: Column) -> Column:
    """The mean to three places, of whole thousandths, so that no tie depends on the order of the cells."""
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, s: a + F.round(s["score"] * 1000).cast("long"))
    return F.when(F.size(scores) == 0, F.lit(0.0)).otherwise(F.round(total / F.size(scores)) / 1000)


def classify(grid: Column) -> Column:
    """The kind whose words occur most; the first of equals; else whether there is any word of finance.
    Cells are joined by blanks; a word is looked up in distinct cells, so none spans two of them."""

    def count(cells: Column) -> dict[str, Column]:
        return {kind: _count(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(cells, w)) for kind, words in TABLE_WORDS.items()}

    def pick(cells: Column, **score: Column) -> Column:
        most = F.greatest(*score.values())
        out = F.when(most == 0, F.when(cells.rlike("|".join(FINANCE_WORDS)), "financial_generic").otherwise("generic"))
        for kind, s in score.items():
            out = out.when(s == most, kind)
        return out

    return let(F.array_join(F.array_distinct(F.flatten(grid)), "\x00"), lambda c: let_all(pick, cells=c, **count(c)))


def parse_tables(df: DataFrame, grid: str = "grid", verify: bool = True, mode: str = "as_coded") -> DataFrame:
    """The whole treatment of a column of grids: headers, rows, type, merged_ranges, checks, anomalies, confidence.

    Numbers are read once per cell and carried along; all else is arithmetic on arrays within the row.
    """
    out = split_headers(df.withColumn("num", numeric_grid(F.col(grid), mode)), grid)
    rows, nums = F.col("rows"), F.col("row_nums")
    out = out.withColumns({"type": classify(F.concat("headers", "rows")), "merged_ranges": merged_ranges(F.col(grid)), "total_col": last_numeric_col(nums), "summable": summable(rows, nums)})
    out = with_row_sums(out).withColumns({"percentage_checks": percentage_checks(rows, nums), "anomaly_flags": anomaly_flags(nums)})
    if not verify:
        none = lambda c: F.filter(c, lambda _: F.lit(False))
        out = out.withColumns({c: none(F.col(c)) for c in ("row_sum_checks", "percentage_checks", "anomaly_flags")})
    out = out.withColumns(
        {
            "_failed": F.transform(F.filter("row_sum_checks", lambda s: ~s["passed"]), lambda s: s["row"]),
            "_odd": F.transform("anomaly_flags", lambda a: F.struct(a["row"].alias("row"), a["col"].alias("col"))),
        }
    )
    out = out.withColumn("confidence_scores", cell_confidence(rows, nums, F.col("_failed"), F.col("_odd")))
    failed = lambda c: F.size(F.filter(F.col(c), lambda x: ~x["passed"]))
    return out.withColumns(
        {
            "table_confidence": table_confidence(F.col("confidence_scores")),
            "num_rows": F.size("rows"),
            "num_cols": width(rows),
            "checks": F.size("row_sum_checks") + F.size("percentage_checks"),
            "failures": failed("row_sum_checks") + failed("percentage_checks"),
        }
    ).drop("num", "row_nums", "total_col", "summable", "_failed", "_odd")


def verification_summary(tables: DataFrame) -> DataFrame:
    """Counts over :func:`parse_tables` rows."""
    return tables.agg(
        F.count("*").alias("tables_checked"),
        F.coalesce(F.sum("checks"), F.lit(0)).alias("total_checks"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("total_failures"),
        (F.coalesce(F.sum("failures"), F.lit(0)) == 0).alias("overall_pass"),
    )


def with_output(tables: DataFrame, kind: str) -> DataFrame:
    """``csv_output`` or ``markdown_output`` of headers and rows; JSON needs no column."""
    whole = F.concat("headers", "rows")
    return {"csv": tables.withColumn("csv_output", grid_to_csv(whole)), "markdown": tables.withColumn("markdown_output", grid_to_markdown(whole))}.get(kind, tables)
