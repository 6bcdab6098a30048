"""Text helpers of merging, prompts, logs and files.  Columns in, columns out."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .numeric import strip
from .vocabulary import CONTINUES, HEADING, INJECTION, SENTENCE_CLOSE, SENTENCE_END, SUPPORTED_SUFFIXES, UNICODE

RSTRIP, LSTRIP = r"(?U)\s+$", r"(?U)^\s+"


def last_char(text: Column) -> Column:
    return F.right(F.regexp_replace(text, RSTRIP, ""), F.lit(1))


def first_char(text: Column) -> Column:
    return F.left(F.regexp_replace(text, LSTRIP, ""), F.lit(1))


def _among(char: Column, chars: str) -> Column:
    return char.isin(*chars)


def continues(a: Column, b: Column) -> Column:
    """Whether text ``b`` goes on where text ``a`` stops."""
    end, begin = last_char(a), first_char(b)
    ended = _among(end, SENTENCE_END + SENTENCE_CLOSE)
    heading = F.regexp_replace(b, LSTRIP, "").rlike(UNICODE + HEADING)
    last_word = F.regexp_extract(F.regexp_replace(a, RSTRIP, ""), r"(?U)(\S+)$", 1)
    torn = (F.length(last_word) <= 2) & F.right(last_word, F.lit(1)).rlike(r"^\p{L}$")
    goes_on = begin.rlike(r"^(\p{Ll}|\p{Nd})$") | (F.ascii(begin) > 0x4E00)
    return F.coalesce(
        (end != "") & (begin != "") & (torn | (~ended & ~heading & _among(begin, CONTINUES)) | (~ended & ~_among(begin, SENTENCE_END) & ~heading & goes_on)),
        F.lit(False),
    )


def join_char(a: Column, b: Column) -> Column:
    """Nothing between Chinese characters; a blank where there was one, or between letters."""
    end, begin = last_char(a), first_char(b)
    cjk = lambda c: c.rlike("^[一-鿿]$")
    letter = lambda c: c.rlike(r"^\p{L}$")
    return F.when(cjk(end) & cjk(begin), "").when(a.endswith(" ") | b.startswith(" "), " ").when(letter(end) & letter(begin), " ").otherwise("")


def context(text: Column, position: Column, window: int) -> Column:
    """Code points around a position (from 0)."""
    start = F.greatest(position - window, F.lit(0))
    return F.substring(text, (start + 1).cast("int"), (position + window - start).cast("int"))


def sanitize(text: Column, limit: int = 2000) -> Column:
    """The first ``limit`` code points, less lines that begin like orders to a model."""
    orders = "(?i)^(" + "|".join(INJECTION) + ")"
    return F.array_join(F.filter(F.split(F.substring(text, 1, limit), "\n", -1), lambda x: ~strip(x).rlike(orders)), "\n")


def json_part(text: Column) -> Column:
    """The JSON in a model's answer: inside a leading fence, else the last fenced block that says so, else from
    the first to the last brace, else all."""
    t = strip(text)
    rows = F.split(t, "\n", -1)
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    fenced = F.when((F.size(body) > 0) & (strip(F.element_at(body, -1)) == "```"), F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body)
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)```json\s*\n(.*?)```"), F.lit(1))
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    return (
        F.when(t.startswith("```"), F.array_join(fenced, "\n"))
        .when(F.size(blocks) > 0, strip(F.try_element_at(blocks, F.lit(-1))))
        .when((first > 0) & t.contains("}") & (last > first), F.substring(t, first, last - first + 1))
        .otherwise(t)
    )


def suffix(path: Column) -> Column:
    """Lower-case last extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(?:[^/\\])(\.[^./\\]+)$", 1))


def file_kind(path: Column) -> Column:
    """pdf, image, office or html by extension; null for anything else."""
    out, ext = F.lit(None).cast("string"), F.regexp_replace(suffix(path), r"^\.", "")
    for kind, names in SUPPORTED_SUFFIXES.items():
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")


def trusted_url(url: Column, domain: str) -> Column:
    """The host is the domain or below it; URLs without a host pass."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return host.isNull() | host.endswith(domain)


def log_line(ts: Column, task: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("]["), task, F.lit("] "), message)


def store_line(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), message)


def duration(start: Column, end: Column) -> Column:
    """Seconds, rounded to hundredths; null unless both are known."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("image/png")), F.lit(";base64,"), F.base64(data))


def decode_data_uri(uri: Column) -> Column:
    """ext and bytes of a base64 data URI; null for other sources."""
    ext = F.regexp_extract(uri, r"^data:[^/,]+/([^;,]+)", 1)
    return F.when(uri.startswith("data:"), F.struct(ext.alias("ext"), F.expr("null").cast("binary").alias("data")).withField("data", F.try_to_binary(F.substring_index(uri, ",", -1), F.lit("base64"))))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching stretches; no built-in has its matching rule."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def expand_env(value, env: dict[str, str]):
    """``${NAME}`` (kept if unset) and ``${NAME:-default}`` in strings of nested settings."""
    import re

    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    if not isinstance(value, str):
        return value
    return re.sub(r"\$\{([^}:]+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), value)
