r"""Substring dedup by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document.  A word goes when a window over it also starts in
a document with a smaller doc_id, judged on the input.

* Documents with equal word sequences are collapsed to the one with the smallest doc_id.
* Suffixes are sampled where the hash of their first ``PREFIX`` words is least in some window: every window
  holds such an anchor, at a place that depends on the window's words alone, so equal windows hold equal
  anchors.  Anchors whose prefix occurs in one document only are dropped - without a copy of its prefix
  a suffix has no copy at all.
* The others are dealt by prefix, each with the words around it that a window over it can reach.  In a
  task, groups of one prefix are read in sorted order; equal contexts meet in a stream and only the first
  stays.  Over the contexts of a batch of groups two trees are built from sorted suffixes and their longest
  common prefixes: one of the words from the anchor on, one of the words before it, backwards.  For each
  place that the anchor may have in a window, the nodes at the depths left and right of it say which windows
  are equal, and which document is the first.  Deep nodes - together WINDOW words or more - are the repeats.
* A prefix with more than ``GROUP`` distinct contexts is not held in memory: its suffixes are extended to the
  whole window and grouped by that prefix of full length, by aggregation with map-side combine.

Defined cases: null or blank text has no words; a document never repeats itself; rows that share a doc_id are
the same document to each other, and each row has its own result; null ids order last; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, chunks, gram_hashes, id_back, id_col, materialize, read, signed, slot_filter, word_hashes

WINDOW = 50
PREFIX = 16
#: Distinct contexts of one prefix that a task holds; a context is at most 2 * WINDOW - PREFIX words.
GROUP = 20_000
BATCH = 8192


def _sliding(h: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width``, by doubling."""
    if len(h) < width:
        return h[:0]
    span, out = 1, h
    while 2 * span <= width:
        out, span = f(out[:-span], out[span:]), 2 * span
    return f(out[: len(h) - width + 1], out[width - span : width - span + len(h) - width + 1])


def anchors(words: np.ndarray, ends: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in word hashes end to end, and their keys.  ``ends``: of the text of each word."""
    grams = gram_hashes(words, prefix)
    low = _sliding(grams, window - prefix + 1, np.minimum)
    if not len(low):
        return np.empty(0, np.int64), grams[:0]
    start = np.arange(len(low))
    low = np.where(start + window <= ends[: len(low)], low, np.uint64(0))  # windows that leave their text don't count
    reach = window - prefix
    padded = np.concatenate([np.zeros(reach, np.uint64), low, np.zeros(reach, np.uint64)])
    most = _sliding(padded, reach + 1, np.maximum)
    at = np.flatnonzero((most == grams) & (grams != 0))
    return at, grams[at]


def digest128(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _profile(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = binary(part, "text")
            flat, sizes = word_hashes(texts)
            ends = np.cumsum(sizes)
            at, keys = anchors(flat, np.repeat(ends, sizes), window, prefix)
            doc = np.searchsorted(ends, at, side="right")
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            place = (at - (ends - sizes)[doc]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(signed(keys)), pa.array(place)], ["key", "pos"])
            whole = [b" ".join((x or b"").split()) for x in texts]
            marks = list(zip(*map(digest128, whole), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes), pa.array(marks[0], pa.int64()), pa.array(marks[1], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in whole]), pa.ListArray.from_arrays(pa.array(offsets), spans)],
                ["doc", "th", "n_words", "s1", "s2", "sha", "anchors"],
            )

    return run


def _contexts(window: int, prefix: int):
    """The words around each wanted anchor: (key, doc, th, pos, before, c1, c2, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 19):
            rows = []
            for doc, th, text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary(part, "text"), part.column(3).to_pylist(), strict=True):
                words = text.split()
                for w in wanted:
                    pos = w["pos"]
                    a = max(0, pos - (window - prefix))
                    own = b" ".join(words[a : pos + window])
                    rows.append((w["key"], doc, th, pos, pos - a, *digest128(b"%d " % (pos - a) + own), own))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "doc", "th", "pos", "before", "c1", "c2", "words"])

    return run


def sorted_tree(key: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of the rows of ``m`` below each key, as sorted order and longest common prefix of each
    row with the one before it (-1 where another key begins): its nodes at depth d are the runs where
    the latter is d or more.  Negative entries end a row and equal nothing."""
    order = np.lexsort([*m.T[::-1], key])
    s, k = m[order], key[order]
    same = (s[1:] == s[:-1]) & (s[1:] >= 0)
    lcp = np.concatenate([[-1], np.where(same.all(1), m.shape[1], (~same).argmax(1))])
    lcp[1:][k[1:] != k[:-1]] = -1
    return order, lcp


def repeats(key: np.ndarray, doc: np.ndarray, before: np.ndarray, words: list[list[bytes]], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and greatest number of words before its anchor at which a window starts
    that also starts in a document with a smaller id; (1, 0) where there is none."""
    n, reach = len(key), window - prefix
    ids: dict[bytes, int] = {}
    right, left = np.full((n, window), -1, np.int32), np.full((n, reach), -1, np.int32)
    for i, own in enumerate(words):
        codes = [ids.setdefault(w, len(ids)) for w in own]
        b = before[i]
        right[i, : len(codes) - b] = codes[b:]
        left[i, :b] = codes[:b][::-1]
    after = np.array([len(x) for x in words]) - before
    r_order, r_lcp = sorted_tree(key, right)
    l_order, l_lcp = sorted_tree(key, left)
    low, high = np.ones(n, np.int64), np.zeros(n, np.int64)
    found = np.zeros(n, bool)
    r_node, l_node = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach + 1):
        r_node[r_order] = np.cumsum(r_lcp < window - o)
        l_node[l_order] = np.cumsum(l_lcp < o)
        rows = np.flatnonzero((before >= o) & (after >= window - o))
        node = r_node[rows] * (n + 1) + l_node[rows]
        order = np.lexsort([doc[rows], node])
        node, rows = node[order], rows[order]
        new = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.empty(0, bool)
        first = doc[rows][new][np.cumsum(new) - 1]
        hit = rows[doc[rows] > first]
        low[hit] = np.where(found[hit], low[hit], o)
        high[hit] = o
        found[hit] = True
    return low, high


def _trees(window: int, prefix: int, limit: int):
    """Rows sorted by key, context and doc to (doc, th, lo, hi): words that repeat; or, for a key with
    more than ``limit`` contexts, the context again (words not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "th", "lo", "hi", "before", "words"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        done: list[tuple] = []  # groups that are complete
        group: list[tuple] = []  # of the key at hand
        out: list[tuple] = []
        key = mark = head = None
        wide = False

        def told() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def solve() -> None:
            if done:
                k, doc, th, pos, before, words = zip(*done, strict=True)
                low, high = repeats(np.array(k), np.array(doc), np.array(before), [w.split(b" ") for w in words], window, prefix)
                out.extend((doc[i], th[i], pos[i] - int(high[i]), pos[i] - int(low[i]) + window, None, None) for i in np.flatnonzero(low <= high))
                done.clear()

        def close() -> None:
            if wide:
                out.extend((r[1], r[2], r[3], 0, r[4], r[5]) for r in group)
            elif len(group) > 1:
                done.extend(group)
            group.clear()

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for k, doc, th, pos, before, c1, c2, words in zip(*cols, strict=True):
                if k != key:
                    close()
                    key, mark, wide = k, None, False
                    if len(done) >= BATCH:
                        solve()
                if (c1, c2) != mark:
                    mark, head = (c1, c2), doc
                elif doc > head:  # all of this context is in a smaller document
                    out.append((doc, th, pos - before, pos - before + words.count(b" ") + 1, None, None))
                    continue
                # a new context, or the same in the same document: its windows go or stay with the first's
                group.append((k, doc, th, pos, before, words))
                if len(group) > limit:
                    wide = True
                    close()
            if len(out) > 10_000:
                yield told()
        close()
        solve()
        yield told()

    return run


def _windows(window: int, prefix: int):
    """Every window over the anchor of a context, by its whole hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, th, pos, before, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = own.split(b" ")
                for s in range(before + 1):
                    if s + window <= len(words):
                        rows.append((*digest128(b" ".join(words[s : s + window])), doc, th, pos - before + s))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["w1", "w2", "doc", "th", "lo"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", 1 << 20):
        rows = []
        for doc, th, text, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary(part, "text"), part.column(3).to_pylist(), strict=True):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int32)
            for s in spans:
                edge[s["lo"]] += 1
                edge[s["hi"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((doc, th, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "th", "n_removed", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """First frame: doc, n_words, n_removed, kept_sha256, one row per row of ``docs``.  Second: the
    repeated stretches of each document that starts a class of equal ones: doc, th, spans (lo, hi)."""
    docs = docs.select(id_col().alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    schema = "doc long, th long, n_words long, s1 long, s2 long, sha string, anchors array<struct<key: long, pos: int>>"
    rows = materialize(docs.mapInArrow(_profile(window, prefix), schema), "sub-profile")
    classes = rows.groupBy("s1", "s2", "n_words").agg(F.min(F.struct("doc", "th")).alias("rep"))
    narrow = rows.select("doc", "th", "n_words", "s1", "s2", "sha").join(classes, ["s1", "s2", "n_words"])
    narrow = materialize(narrow.select("doc", "th", "n_words", "sha", F.col("rep.doc").alias("rep"), F.col("rep.th").alias("rep_th")), "sub-rows")
    reps = narrow.where("doc = rep and th = rep_th").select("doc", "th").distinct()
    marked = rows.where(F.size("anchors") > 0).select("doc", "th", "anchors").join(reps, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    marked = materialize(marked.select("doc", "th", F.inline("anchors")), "sub-anchors")
    shared = marked.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("key")
    wanted = marked.join(shared, "key").groupBy("doc", "th").agg(F.collect_list(F.struct("key", "pos")).alias("wanted"))
    wanted = materialize(wanted, "sub-wanted")
    texts = slot_filter(docs, wanted, ["doc", "th"]).dropDuplicates(["doc", "th"]).join(wanted, ["doc", "th"]).select("doc", "th", "text", "wanted")
    around = texts.mapInArrow(_contexts(window, prefix), "key long, doc long, th long, pos int, before int, c1 long, c2 long, words binary")
    around = around.repartition("key").sortWithinPartitions("key", "c1", "c2", "doc")
    solved = around.mapInArrow(_trees(window, prefix, group), "doc long, th long, lo int, hi int, before int, words binary")
    solved = materialize(solved, "sub-solved")
    spans = solved.where("words is null").select("doc", "th", "lo", "hi")
    wide = solved.where("words is not null").select("doc", "th", F.col("lo").alias("pos"), "before", "words")
    if not wide.isEmpty():
        starts = materialize(wide.mapInArrow(_windows(window, prefix), "w1 long, w2 long, doc long, th long, lo int"), "sub-windows")
        first = starts.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last")
        late = starts.join(first, ["w1", "w2"]).where("doc > first").select("doc", "th", "lo", (F.col("lo") + window).alias("hi"))
        spans = spans.unionAll(late)
    spans = materialize(spans.groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "sub-spans")
    cut = slot_filter(docs, spans, ["doc", "th"]).dropDuplicates(["doc", "th"]).join(spans, ["doc", "th"]).select("doc", "th", "text", "spans")
    cut = cut.mapInArrow(_cut, "doc long, th long, n_removed long, kept_sha256 string, kept binary").select(F.col("doc").alias("rep"), F.col("th").alias("rep_th"), "n_removed", "kept_sha256")
    found = narrow.join(materialize(cut, "sub-cut"), ["rep", "rep_th"], "left")
    copy = (F.col("doc") > F.col("rep")) & (F.col("n_words") >= window)
    return found.select(
        "doc",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ), spans


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = dedup_substrings(read(spark, sf_dir, "documents"))
    return found.select(id_back("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
#: Windows of 50 words of whole tables are too many for SQL there: tested against brute force.
ORACLE: dict[str, str] = {}
