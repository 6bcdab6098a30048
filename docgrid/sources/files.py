"""Documents in and results out: scans by file kind, office files, page ranges, JSON, CSV and Markdown sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.grid import BLOCKS, grid_to_csv, grid_to_markdown, html_to_blocks
from ..functions.text import file_kind, safe_name, suffix

MAX_UPLOAD = 100 << 20
CLOUD_PAGES, CLOUD_BYTES, LIGHT_BYTES = 200, 200 << 20, 10 << 20
PAGE_BREAK = "\n\n---\n\n"


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length, content, suffix, kind, reject: the reason why a file isn't read, instead of an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    kind = file_kind(F.col("path"))
    reject = F.when(kind.isNull(), "unsupported").when(F.col("length") > MAX_UPLOAD, "too large").when(F.col("length") == 0, "empty")
    return files.select("path", "length", "content", suffix(F.col("path")).alias("suffix"), kind.alias("kind"), reject.alias("reject"))


def chosen_parser(kind: Column, length: Column, pages: Column, token: bool = False) -> Column:
    """What reads a file: its basic parser, or with a token the cloud, in parts if it has many pages."""
    basic = F.concat(kind, F.lit("_basic"))
    if not token:
        return F.when(length <= LIGHT_BYTES, basic).otherwise(basic)
    return F.when(length > CLOUD_BYTES, basic).when(pages > CLOUD_PAGES, "cloud_split").otherwise("cloud_precise")


def page_ranges(pages: Column, size: int = CLOUD_PAGES) -> Column:
    """start (from 0), stop and name suffix of the parts of a long document."""
    starts = F.when(pages > 0, F.sequence(F.lit(0), (pages - 1).cast("int"), F.lit(size)))
    return F.coalesce(
        F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.least(s + size, pages.cast("int")).alias("stop"), F.format_string("part%d_%d-%d", i, s + 1, F.least(s + size, pages.cast("int"))).alias("part"))),
        F.array().cast("array<struct<start: int, stop: int, part: string>>"),
    )


def join_parts(parts: DataFrame, key: str = "doc_id", order: str = "part", pages: str = "pages") -> DataFrame:
    """Adds ``page_offset``: pages of the parts before; parts that failed (null pages) don't count."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("page_offset", F.coalesce(F.sum(pages).over(before), F.lit(0)))


def html_blocks(pages: DataFrame, key: str, source: str = "html") -> DataFrame:
    """One row a block: key, pos, type, text, markdown, data, src, alt."""
    return pages.select(key, F.posexplode(html_to_blocks(source)).alias("pos", "b")).select(key, "pos", "b.*")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _block(type_: str, text: str | None = None, markdown: str | None = None, data: list[list[str]] | None = None, src: str | None = None) -> dict:
    return {"type": type_, "text": text, "markdown": markdown, "data": data, "src": src, "alt": None}


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs with their headings, then tables, then the names of pictures."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        media = [n for n in z.namelist() if n.startswith("word/media/")]
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for p in body.findall(f"{_W}p"):
        if line := text(p).strip():
            style = p.find(f"{_W}pPr/{_W}pStyle")
            level = {"Heading1": "# ", "Heading2": "## ", "Heading3": "### "}.get(style.get(f"{_W}val", "") if style is not None else "", "")
            out.append(_block("text", line, level + line))
    for table in body.findall(f"{_W}tbl"):
        rows = [[text(c).strip() for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]
        out.append(_block("table", data=[r for r in rows if r]))
    return out + [_block("image", src=n) for n in media]


def pptx_blocks(content: bytes) -> list[dict]:
    """Per slide its number, paragraphs and tables; then the names of pictures."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(c for c in n if c.isdigit())))
        for i, name in enumerate(slides, 1):
            out.append(_block("text", f"--- Slide {i} ---", f"## Slide {i}"))
            root = ElementTree.fromstring(z.read(name))
            for shape in root.iter(f"{_P}txBody"):
                for p in shape.findall(f"{_A}p"):
                    if line := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip():
                        out.append(_block("text", line, line))
            for table in root.iter(f"{_A}tbl"):
                out.append(_block("table", data=[["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")] for r in table.findall(f"{_A}tr")]))
        out += [_block("image", src=n) for n in z.namelist() if n.startswith("ppt/media/")]
    return out


def parse_files(files: DataFrame, extra: dict[str, Callable[[bytes], list[dict]]] | None = None) -> DataFrame:
    """path, blocks, error of :func:`scan` rows.  HTML, DOCX and PPTX are read here; parsers for PDF and images are
    plugged in as ``extra`` by kind or suffix.  A file that can't be read keeps its row."""
    from ..functions.grid import html_content

    parsers: dict[str, Callable[[bytes], list[dict]]] = {
        ".html": lambda b: html_content(b.decode("utf-8", "replace")), ".htm": lambda b: html_content(b.decode("utf-8", "replace")),
        ".docx": docx_blocks, ".pptx": pptx_blocks, **(extra or {}),
    }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, ext, kind, reject in zip(pdf["path"], pdf["content"], pdf["suffix"], pdf["kind"], pdf["reject"], strict=True):
                parser = parsers.get(ext) or parsers.get(kind)
                if reject or parser is None:
                    rows.append((path, [], reject or "no parser"))
                    continue
                try:
                    rows.append((path, parser(bytes(content)), None))
                except Exception as e:  # a broken file is a row, not the end of the job
                    rows.append((path, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "blocks", "error"])

    return files.select("path", "content", "suffix", "kind", "reject").mapInPandas(run, StructType([StructField("path", StringType()), StructField("blocks", BLOCKS), StructField("error", StringType())]))


def write_results(df: DataFrame, path: str, kind: str = "json", grid: str = "grid") -> None:
    """JSON lines, or one text row a table as CSV or Markdown."""
    if kind == "json":
        df.write.json(path)
    else:
        df.select({"csv": grid_to_csv, "markdown": grid_to_markdown}[kind](F.col(grid)).alias("value")).write.text(path)


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts of :func:`parse_files` rows by outcome."""
    return results.groupBy(F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status")).agg(F.count("*").alias("files"), F.sum(F.size("blocks")).alias("blocks"))


def output_name(path: Column) -> Column:
    """Name of a file's folder of results."""
    return safe_name(F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]+$", ""))
