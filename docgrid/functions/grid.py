"""Grids (array<array<string>>) from and to text, Markdown, CSV and HTML."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .let import let, let_all
from .numeric import strip

GRID = ArrayType(ArrayType(StringType()))
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"


def width(grid: Column) -> Column:
    """Cells of the longest row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))


def pad(grid: Column) -> Column:
    """Rows filled with empty cells to the longest one's length."""
    return let_all(lambda g, w: F.transform(g, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))), g=grid, w=width(grid))


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, _BREAKS), strip), lambda x: x != "")


def _edges(cells: Column) -> Column:
    """Without one empty cell at each end, as outer bars leave them."""
    front = lambda c: F.when((F.size(c) > 0) & (F.get(c, F.lit(0)) == ""), F.slice(c, F.lit(2), F.size(c))).otherwise(c)
    back = lambda c: F.when((F.size(c) > 0) & (F.try_element_at(c, F.lit(-1)) == ""), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
    return let(let(cells, front), back)


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), strip)


def text_to_grid(text: Column) -> Column:
    """Tabs, else bars, else runs of blanks - as the first line has them - part the cells."""

    def part(rows: Column) -> Column:
        first = F.get(rows, F.lit(0))
        tabs = F.transform(rows, lambda x: F.split(x, "\t"))
        bars = F.transform(rows, lambda x: _edges(_cells(x)))
        return F.when(first.contains("\t"), tabs).when(first.contains("|"), bars).otherwise(F.transform(rows, lambda x: F.split(x, "  +")))

    return let(lines(text), lambda rows: F.when(F.size(rows) == 0, F.array().cast(GRID)).otherwise(pad(part(rows))))


def markdown_to_grid(text: Column) -> Column:
    """Lenient: any line with a bar is a row, except separators; rows are padded."""
    rows = F.filter(lines(text), lambda x: ~x.rlike(r"(?U)^\|[\s\-:|]+\|$") & x.contains("|"))
    return pad(F.filter(F.transform(rows, lambda x: _edges(_cells(x))), lambda r: F.size(r) > 0))


def markdown_rows(text: Column) -> Column:
    """Strict: lines that begin with a bar; rows whose cells are all rules go; no padding."""
    rows = F.filter(F.transform(F.split(strip(text), _BREAKS), strip), lambda x: x.startswith("|"))
    parted = F.transform(rows, lambda x: _cells(F.regexp_replace(x, r"^\|+|\|+$", "")))
    return F.filter(parted, lambda r: ~F.forall(r, lambda c: c.rlike("^[-:]+$")))


def grid_to_markdown(grid: Column) -> Column:
    """A table with the first row as its head; empty for no rows."""

    def lay(rows: Column, w: Column) -> Column:
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), w), " | "), F.lit(" |"))
        below = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
        return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), below), "\n"))

    return let_all(lay, rows=F.transform(pad(grid), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), w=width(grid))


def grid_to_csv(grid: Column) -> Column:
    """Minimal quoting, rows ended by CR LF; a row of one empty cell is quoted so that it isn't lost."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    row = lambda r: F.when((F.size(r) == 1) & (F.get(r, F.lit(0)) == ""), F.lit('""')).otherwise(F.array_join(F.transform(r, quoted), ","))
    return F.array_join(F.transform(grid, lambda r: F.concat(row(r), F.lit("\r\n"))), "")


# -- HTML: spans need a running occupancy of cells, which no built-in expresses --------------------


class _Cells(HTMLParser):
    """Rows of (text, colspan, rowspan)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.row: list[tuple[str, int, int]] | None = None
        self.text: list[str] | None = None
        self.spans = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            own = dict(attrs)
            self.text, self.spans = [], tuple(_span(own.get(k)) for k in ("colspan", "rowspan"))

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None:
            if self.row is not None:
                self.row.append((" ".join("".join(self.text).split()), *self.spans))
            self.text = None
        elif tag == "tr":
            if self.row is not None:
                self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def _span(value: str | None) -> int:
    try:
        return max(1, int(value or 1))
    except ValueError:
        return 1


def html_grid(source: str | None) -> list[list[str]]:
    """The rows of an HTML table with spans filled in: a cell takes the next free places of its row and as many
    rows below; rows that only a span reaches are kept."""
    reader = _Cells()
    reader.feed(source or "")
    reader.close()
    places: dict[tuple[int, int], str] = {}
    for r, row in enumerate(reader.rows):
        c = 0
        for text, across, down in row:
            while (r, c) in places:
                c += 1
            places.update({(r + i, c + j): text for i in range(down) for j in range(across)})
            c += across
    if not places:
        return []
    columns = 1 + max(c for _, c in places)
    used = sorted({r for r, _ in places})
    return [[places.get((r, c), "") for c in range(columns)] for r in used]


@F.pandas_udf(GRID)
def html_to_grid(source: pd.Series) -> pd.Series:
    return source.map(html_grid)


_SKIP = ("script", "style", "nav", "footer", "header")
_TEXTS = ("h1", "h2", "h3", "h4", "p", "li")
_MARK = {"h1": "# ", "h2": "## ", "h3": "### ", "li": "- "}


class _Blocks(HTMLParser):
    """Title, headings, paragraphs and items in order of their start; then tables; then images."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.title: list[str] | None = None
        self.in_title = False
        self.open: list[tuple[str, list[str]]] = []
        self.texts: list[tuple[str, list[str]]] = []
        self.images: list[dict[str, str]] = []
        self.tables: list[list[list[list[str]]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        own = {k: v or "" for k, v in attrs}
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag in _TEXTS:
            if tag == "p":  # a paragraph ends the one before it
                self.open = [x for x in self.open if x[0] != "p"]
            self.open.append((tag, []))
            self.texts.append(self.open[-1])
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
            self.tables[-1][-1].append(self.cell)
        elif tag == "img":
            self.images.append({"src": own.get("src", ""), "alt": own.get("alt", "")})

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "title":
            self.in_title = False
        elif tag in ("td", "th"):
            self.cell = None
        else:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k]
                    break

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title.append(data)
        for _, parts in self.open:
            parts.append(data)
        if self.cell is not None:
            self.cell.append(data)


def _joined(parts: list[str]) -> str:
    return "".join(p.strip() for p in parts)


BLOCKS = ArrayType(StructType([StructField(c, GRID if c == "data" else StringType()) for c in ("type", "text", "markdown", "data", "src", "alt")]))


def html_content(source: str | None) -> list[dict]:
    reader = _Blocks()
    reader.feed(source or "")
    reader.close()
    out = []
    block = lambda type, text=None, markdown=None, data=None, src=None, alt=None: {"type": type, "text": text, "markdown": markdown, "data": data, "src": src, "alt": alt}  # noqa: A002, E731
    title = "".join(reader.title or []).strip()
    if title:
        out.append(block("text", title, f"# {title}"))
    for tag, parts in reader.texts:
        if text := _joined(parts):
            out.append(block("text", text, _MARK.get(tag, "") + text))
    for table in reader.tables:
        if rows := [[_joined(c) for c in row] for row in table if row]:
            n = max(map(len, rows))
            shown = ["| " + " | ".join(r + [""] * (n - len(r))) + " |" for r in rows]
            out.append(block("table", None, "\n".join([shown[0], "| " + " | ".join(["---"] * n) + " |", *shown[1:]]), rows))
    out += [block("image", src=x["src"], alt=html.unescape(x["alt"])) for x in reader.images]
    return out


@F.pandas_udf(BLOCKS)
def html_to_blocks(source: pd.Series) -> pd.Series:
    return source.map(html_content)


# -- merged cells ------------------------------------------------------------------------------------


def merged_cells(grid: list[list[str]] | None) -> list[dict[str, int]]:
    """Stretches of equal cells across, and down as long as the whole stretch repeats; single cells and
    plain columns aren't told."""
    grid, taken, out = grid if grid is not None else [], set(), []
    for r, row in enumerate(grid):
        for c, value in enumerate(row):
            if (r, c) in taken or not value:
                continue
            right = c + 1
            while right < len(row) and row[right] == value and (r, right) not in taken:
                right += 1
            down = r + 1
            if right - c > 1:
                while down < len(grid) and all(k < len(grid[down]) and grid[down][k] == value and (down, k) not in taken for k in range(c, right)):
                    down += 1
                out.append({"row_start": r, "col_start": c, "row_end": down, "col_end": right})
            taken.update((i, j) for i in range(r, down) for j in range(c, right))
    return out


@F.pandas_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("row_start", "col_start", "row_end", "col_end")])))
def merged_ranges(grid: pd.Series) -> pd.Series:
    return grid.map(merged_cells)
