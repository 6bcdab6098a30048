r"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

A record is a JSON object.  Its fingerprint is a hash of the sorted set of its nested field paths
(``messages[].role``); :data:`LAYOUTS` declares, for each known layout, which paths it has and where
its turns are.  The fingerprint - not trial and error - selects the mapping.

Template, for each turn: ``<turn role="ROLE">\nTEXT</turn>\n``.  Inside texts and roles a backslash
is doubled and ``<`` becomes ``\<``, so that no text can hold a mark; in roles the quote is ``\q`` and the
line break ``\n``.  The loss mask is the spans of assistant texts, in code points of the formatted string.

Defined cases: null text and null role are empty; a record that isn't an object, or has an unknown
fingerprint, stays as a row with layout ``unknown`` and no turns; turns tie by (turn, role, text);
null turn numbers come first; a null conversation id is a conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

Turn = tuple[str, str]


@dataclass(frozen=True)
class Layout:
    """``turns``: path of a list with a role and a text field; else ``parts``: (role, paths joined by
    a blank line).  ``optional`` paths may be missing; the rest must be there, nothing else may be."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        optional = [x for k in range(len(self.optional) + 1) for x in combinations(self.optional, k)]
        found = [fingerprint_of({*self.paths, *x}) for x in optional]
        if self.turns:  # a list without elements has no paths below it
            below = f"{self.turns[0]}[]"
            found += [fingerprint_of({below, *(p for p in x if not p.startswith(below))}) for x in optional]
        return found


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), ("id", "system"), turns=("messages", "role", "content")),
    Layout("share", ("conversations[].from", "conversations[].value"), ("id", "system"), turns=("conversations", "from", "value"), roles=ROLES),
    Layout("dialog", ("turns[].speaker", "turns[].text"), ("id",), turns=("turns", "speaker", "text"), roles=ROLES),
    Layout("instruction", ("instruction", "output"), ("input", "system", "id"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("completion", ("completion", "prompt"), ("system", "id"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system", "id"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("answer", "question"), ("context", "id"), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def paths_of(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict) and value:
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint_of(paths: set[str]) -> str:
    return xxhash.xxh3_64_hexdigest("\n".join(sorted(paths)))


def mapping_table(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    return {f: x for x in reversed(layouts) for f in x.fingerprints()}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: object, layout: Layout) -> list[Turn]:
    found = [("system", _text(record["system"]))] if "system" in record and "system" in layout.optional else []
    if layout.turns:
        rows, role, text = layout.turns
        return found + [(layout.roles.get(r := _text(x.get(role)), r), _text(x.get(text))) for x in record[rows]]
    return found + [(role, "\n\n".join(y for p in parts if (y := _text(record.get(p))) or len(parts) == 1)) for role, parts in layout.parts]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\<])", r"\1", text)


def _role(role: str) -> str:
    return escape(role).replace('"', "\\q").replace("\n", "\\n")


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"q": '"', "n": "\n"}.get(m[1], m[1]), role)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f'<turn role="{_role(role)}">\n', escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, "</turn>\n")
        at += len(head) + len(body) + 8
    return "".join(parts), spans


TURN = re.compile(r'<turn role="((?:[^"\\<]|\\.)*+)">\n((?:[^\\<]|\\.)*+)</turn>\n', re.S)


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted string; raises if anything is left over."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((_unrole(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_chat(records: DataFrame, key: str, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``key`` (long) and a JSON column to: key, layout, fingerprint, formatted, loss (array of start, end)."""
    table = mapping_table(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                print_ = fingerprint_of(paths_of(value)) if isinstance(value, dict) else None
                layout = table.get(print_)
                formatted, spans = render(turns_of(value, layout)) if layout else ("", [])
                out.append((layout.name if layout else "unknown", print_, formatted, [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], span)],
                [key, "layout", "fingerprint", "formatted", "loss"],
            )

    schema = f"`{key}` long, layout string, fingerprint string, formatted string, loss array<struct<start: long, end: long>>"
    return records.select(F.col(key).cast("long").alias(key), F.col(record)).mapInArrow(run, schema)


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """Digests of what the formatted strings and their loss masks say, from nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = f"`{key}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(key, "formatted", "loss").mapInArrow(run, schema)


def records_of_turns(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to one JSON record of the messages layout each."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    messages = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return listed.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


PROBE = r"\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return read_back(format_chat(records_of_turns(rows.unionAll(probe)), "conv_id"), "conv_id")


QUERIES = {"op9_chat": op9_chat}
ORACLE = {
    "op9_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(23 + length(replace(replace(text, '\', '\\'), '<', '\<'))
             + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\<'), '"', '\q'), chr(10), '\n')))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM said"""
}
