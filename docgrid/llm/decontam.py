"""Benchmark decontamination: prefix-filtered containment join, verified on item-sized windows.

Words are ``[0-9a-z\\x80-]+`` after lower-casing A-Z.  A window is ``n`` consecutive words of an item
(an item with fewer words, but not none, is one window).  A document contains a window only if it
contains the window's rarest word, so that word - rarest by a count over the whole corpus - is the
necessary prefix of the window (prefix length: size - required overlap + 1 = 1).  Occurrences of prefix words in
documents are the only candidates; the length bound (enough words before and after) and the
position of the word in the window fix where the window would start, and the words there are compared.

The index of the items goes to the tasks.  It is bounded: items are taken in blocks of at most
``BLOCK_BYTES`` of text, each block one pass over the documents, so that a benchmark of any size is
handled whole.

Defined cases: null text has no words; null item ids are written as the empty string; rows with one
item id are one item; empty documents or an empty benchmark give no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import binary, chunks, materialize, read

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Bytes to words: A-Z to lower case, all else that is not a word character to a blank.
TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    # after the translation a blank is the only ASCII white space left
    return (text or b"").translate(TABLE).split()


def count_vocabulary(docs: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How often each word of the vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(vocabulary)}
        total = np.zeros(len(ids) + 1, np.int64)
        for part in chunks(batches, "text"):
            words = [w for text in binary(part, "text") for w in words_of(text)]
            found = np.fromiter(map(ids.get, words, repeat(len(ids))), np.int64, count=len(words))
            total += np.bincount(found, minlength=len(total))
        seen = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if vocabulary:
        for word, n in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
            out[word] = n
    return out


class Index:
    """Windows of a block of items, found by their rarest word."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int) -> None:
        self.n = n
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - n + 1) if words else 0):
                owners[tuple(words[i : i + n])].add(item)
        self.windows = list(owners)
        self.owners = [sorted(x) for x in owners.values()]
        self.vocabulary = sorted({w for x in self.windows for w in x})

    def arrange(self, counts: np.ndarray) -> Index:
        ids = {w: i for i, w in enumerate(self.vocabulary)}
        size = len(self.windows)
        self.words = np.full((size, self.n), -2, np.int64)
        self.length = np.array([len(x) for x in self.windows], np.int64)
        prefix, self.offset = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k, x in enumerate(self.windows):
            own = [ids[w] for w in x]
            self.words[k, : len(own)] = own
            at = min(range(len(own)), key=lambda j: (counts[own[j]], own[j], j))
            prefix[k], self.offset[k] = own[at], at
        self.order = np.argsort(prefix, kind="stable")
        self.many = np.bincount(prefix, minlength=len(ids) + 1)  # the last stands for words outside
        self.first = np.concatenate([[0], np.cumsum(self.many)[:-1]])
        return self

    def matches(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows that occur; ids: word ids of texts end to end, low and high: the bounds
        of the text that each word is in."""
        at = np.flatnonzero(self.many[ids])
        many = self.many[ids[at]]
        pos = np.repeat(at, many)
        step = np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
        window = self.order[np.repeat(self.first[ids[at]], many) + step]
        start = pos - self.offset[window]
        fits = (start >= low[pos]) & (start + self.length[window] <= high[pos])
        start, window = start[fits], window[fits]
        for j in range(self.n):
            inside = j < self.length[window]
            same = ~inside | (ids[np.where(inside, start + j, 0)] == self.words[window, j])
            start, window = start[same], window[same]
        return start, window


def _hits(index: Index, last: bool, carry: bool, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(index.vocabulary)}
        for part in chunks(batches, text):
            lists = [words_of(x) for x in binary(part, text)]
            sizes = np.array([len(x) for x in lists], np.int64)
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(lists)), sizes)
            flat = np.fromiter((v for x in lists for v in map(ids.get, x, repeat(len(ids)))), np.int64, count=int(sizes.sum()))
            if len(index.windows):
                start, window = index.matches(flat, (ends - sizes)[doc], ends[doc])
            else:
                start = window = np.empty(0, np.int64)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, start, 1)
            if len(start):
                np.add.at(edge, start + index.length[window], -1)
            hit = np.cumsum(edge[:-1]) > 0
            items: dict[int, set[str]] = defaultdict(set)
            for d, w in set(zip(doc[start].tolist(), window.tolist(), strict=True)):
                items[d].update(index.owners[w])
            before = part.column(part.schema.get_field_index("_hit")).to_pylist()
            known = part.column(part.schema.get_field_index("_items")).to_pylist()
            bits, names = [], []
            for d in range(len(lists)):
                own = hit[ends[d] - sizes[d] : ends[d]]
                if before[d]:
                    own = own | np.unpackbits(np.frombuffer(before[d], np.uint8), count=len(own)).astype(bool)
                bits.append(own)
                names.append(sorted(items.get(d, set()) | set(known[d] or ())))
            if not last:
                packed = pa.array([np.packbits(x).tobytes() if x.any() else None for x in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], packed, pa.array(names, pa.list_(pa.string()))], part.schema.names)
                continue
            n_hit = [int(x.sum()) for x in bits]
            rest = [part.column(part.schema.get_field_index("_row"))] if carry else []
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array([x > 0 for x in n_hit]),
                    pa.array(names, pa.list_(pa.string())),
                    *rest,
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *["_row"] * carry],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items; with
    ``carry`` also ``_row``, all columns of ``docs`` as a struct."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    # a text travels once: in the row, where that has it as a string
    text = "_row.text" if carry and docs.schema["text"].dataType == StringType() else "_text"
    own += [F.col("text").cast("string").alias("_text")] if text == "_text" else []
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own).withColumns(
        {"_hit": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")}
    )
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # at most about a block's bytes
        index = Index([(r.item, bytes(r.text)) for r in rows], n)
        index.arrange(count_vocabulary(docs, index.vocabulary))
        if b < blocks - 1:
            state = materialize(state.mapInArrow(_hits(index, False, carry, text), state.schema), "decontam-block")
    schema = StructType.fromDDL("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")
    return state.mapInArrow(_hits(index, True, carry, text), schema.add(state.schema["_row"]) if carry else schema)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {"op6_decontam": op6_decontam}
#: Sequences of words against sequences of words: too slow in SQL on whole tables, tested against brute force.
ORACLE: dict[str, str] = {}
