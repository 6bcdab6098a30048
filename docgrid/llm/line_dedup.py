r"""Line dedup by a deletion-neighbourhood join.

Lines are the pieces of a text between line feeds, without white space at the ends; empty ones stay.  A line goes
when an earlier one - by doc_id, then place - is equal or, where both have ``MIN_CHARS`` code points at least, one edit
away (a character changed, added or left out), judged on the input.  Earliest lines stay.  An edit makes another word
of a short line, so those go as exact copies only.

* Equal lines are collapsed first: one row a distinct line, with its earliest place (map-side combine).
* One edit leaves one half of the shorter line whole, so only lines that share a half (in the place that
  their lengths allow) with another are of interest: four keys a line.
* For those, the deletion neighbourhood is emitted as hashed keys: the line with one character left out,
  once with the place of the hole (a changed character: both sides have the same rest and hole) and once
  without (an added one: the other side is the rest itself, which is emitted whole).  Keys are sorted by
  Spark.  Of a key with a hole each line meets the earliest; of one without, the whole line, if there is one,
  meets each of the others.  The stream has bounded memory, and a key that very many lines share costs one
  pair a line.  The edit distance of every such pair is then verified on the texts.

Defined cases: null text has no lines and stays null; empty text is one empty line, kept; a line of any length is one
row of hashes, and a text is split whole; no rows give none; rows that share doc_id and text are one document; null ids order last; other columns of
``docs`` ride along in :func:`dedup_lines`, packed, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLOTS, chunks, id_col, materialize, mix, read, signed, slot_filter

MIN_CHARS = 20
BLANK = " \t\n\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def lines_of(text: str) -> list[str]:
    return [x.strip(BLANK) for x in text.split("\n")]


def half_keys(line: str) -> list[int]:
    """Own prefix, own suffix (for lines as long, or one longer, to meet), and the two halves that a line
    one shorter would have."""
    out = []
    for size in (len(line), len(line) - 1):
        cut = size // 2
        for side, part in (("p", line[:cut]), ("s", line[len(line) - (size - cut) :])):
            out.append(xxhash.xxh3_64_intdigest(f"{side}{size}:{part}".encode("utf-8", "surrogatepass")) - (1 << 63))
    return out


WHOLE, HOLE, GONE = 0, 1, 2


def variants(line: str, prefix: bool, suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashed deletion neighbourhood, and the kind of each key; ``prefix``: the first half is whole, so holes
    are behind it."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    power = np.ones(n, np.uint64)
    if n > 1:
        power[1:] = np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(codes * power, dtype=np.uint64)])
    total = upto[-1]
    spots = np.arange(0 if suffix else (n - 1) // 2, n if prefix else n // 2 + 1)
    spots = spots[spots < n]
    rest = upto[spots] + (total - upto[spots + 1]) * np.uint64(_INVERSE)
    hole = mix(mix(rest) + spots.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    gone = np.unique(mix(mix(rest) + np.uint64(2 * (n - 1) << 20)))
    whole = mix(mix(total[None]) + np.uint64(2 * n << 20))
    kind = np.repeat(np.array([HOLE, GONE, WHOLE], np.int8), [len(hole), len(gone), 1])
    return np.concatenate([hole, gone, whole]), kind


def within_one(x: str, y: str) -> bool:
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    low, high = 0, len(x)
    while low < high:  # the longest common prefix, by bisection over slices
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid - 1)
    return x[low + (len(x) == len(y)) :] == y[low + 1 :]


_LINE = "doc long, th long, line int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"


def _index(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _LINE.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
        for part in chunks(batches, "text"):
            rows = []
            for doc, th, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                for i, line in enumerate(lines_of(text)):
                    if line:
                        h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
                        rows.append((doc, th, i, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), *(half_keys(line) if len(line) >= min_chars else [None] * 4)))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the lines that ``wanted`` names: struct(line, prefix, suffix)."""
    for part in chunks(batches, "text", 1 << 19):
        keys, kinds, doc, th, line = [], [], [], [], []
        for d, t, text, wanted in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            own = lines_of(text)
            for w in wanted:
                found, kind = variants(own[w["line"]], w["p"], w["s"])
                keys.append(found)
                kinds.append(kind)
                doc.append(np.full(len(found), d))
                th.append(np.full(len(found), t))
                line.append(np.full(len(found), w["line"], np.int32))
        if keys:
            arrays = [signed(np.concatenate(keys)), np.concatenate(kinds), np.concatenate(doc), np.concatenate(th), np.concatenate(line)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "kind", "doc", "th", "line"])


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, earlier place) of the pairs of a key, from rows sorted by key, kind and place."""
    last = head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, kind, *place = (c.to_numpy() for c in batch.columns)
        new = np.empty(len(key), bool)
        new[0] = last is None or key[0] != last
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        owner = np.cumsum(new) - 1
        first = [np.append(c[begin], c.dtype.type(0) if head is None else head[i])[owner] for i, c in enumerate((kind, *place))]
        ok = ~new & ((kind == HOLE) | (first[0] == WHOLE) & (kind == GONE))
        rows = np.stack([c[ok].astype(np.int64) for c in (*place, *first[1:])])
        # the later of the two places first; a pair that several keys of the batch name is told once
        x, y = rows[:3], rows[3:]
        less = (x[0] < y[0]) | (x[0] == y[0]) & ((x[1] < y[1]) | (x[1] == y[1]) & (x[2] < y[2]))
        rows = np.concatenate([np.where(less, y, x), np.where(less, x, y)])[:, (x != y).any(0)]
        rows = np.unique(rows, axis=1) if rows.shape[1] else rows
        arrays = [pa.array(c, pa.int32() if i % 3 == 2 else pa.int64()) for i, c in enumerate(rows)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc", "th", "line", "doc2", "th2", "line2"])
        if len(begin):
            head = [c[begin[-1]] for c in (kind, *place)]
        last = key[-1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", 1 << 20):
        rows = [(d, t, i, own[i]) for d, t, text, wanted in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True) for own in [lines_of(text)] for i in wanted]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc", "th", "line", "own"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [within_one(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield batch.select(["doc", "th", "line"]).filter(pa.array(keep, pa.bool_()))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``: doc, th, text (not null).  The lines that go: doc, th, gone (array of line numbers)."""
    place = ["doc", "th", "line"]
    lines = materialize(docs.mapInArrow(_index(min_chars), _LINE), "line-index")
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct(*place, "k0", "k1", "k2", "k3")).alias("f"), F.count("*").alias("n"))
    distinct = materialize(distinct.select("h1", "h2", "n", "f.*"), "line-distinct")
    # halves that an own half and another line share; own keys name the class of lengths
    key = F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i < 2).alias("own"), F.lit(i % 2 == 0).alias("p")) for i in range(4)]))
    halves = distinct.where("k0 is not null").select(*place, key.alias("k")).select(*place, "k.*")
    shared = halves.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("key")
    alive = halves.join(shared, "key").groupBy(*place).agg(F.max("p").alias("p"), F.max(~F.col("p")).alias("s"))
    wanted = materialize(alive.groupBy("doc", "th").agg(F.collect_list(F.struct("line", "p", "s")).alias("wanted")), "line-wanted")
    keys = slot_filter(docs, wanted, ["doc", "th"]).join(wanted, ["doc", "th"]).select("doc", "th", "text", "wanted")
    keys = keys.mapInArrow(_neighbours, "key long, kind byte, doc long, th long, line int")
    pairs = keys.repartition("key").sortWithinPartitions("key", "kind", *place)
    pairs = materialize(pairs.mapInArrow(_earliest, "doc long, th long, line int, doc2 long, th2 long, line2 int").distinct(), "line-pairs")
    other = pairs.select(F.col("doc2").alias("doc"), F.col("th2").alias("th"), F.col("line2").alias("line"))
    named = pairs.select(*place).union(other).distinct().groupBy("doc", "th").agg(F.collect_list("line").alias("wanted"))
    named = materialize(named, "line-named")
    texts = slot_filter(docs, named, ["doc", "th"]).join(named, ["doc", "th"]).select("doc", "th", "text", "wanted")
    texts = materialize(texts.mapInArrow(_texts, "doc long, th long, line int, own string"), "line-texts")
    texts = texts.dropDuplicates(place)
    theirs = texts.select(F.col("doc").alias("doc2"), F.col("th").alias("th2"), F.col("line").alias("line2"), F.col("own").alias("other"))
    checked = pairs.join(texts, place).join(theirs, ["doc2", "th2", "line2"]).select(*place, "own", "other")
    near = materialize(checked.mapInArrow(_verify, "doc long, th long, line int").distinct(), "line-near")
    # a distinct line with an earlier neighbour goes everywhere; else all but its first place go
    marked = distinct.join(near.withColumn("near", F.lit(True)), place, "left").where("n > 1 or near")
    first = marked.select("h1", "h2", "near", *[F.col(c).alias(f"f_{c}") for c in place])
    same = (F.col("doc") == F.col("f_doc")) & (F.col("th") == F.col("f_th")) & (F.col("line") == F.col("f_line"))
    gone = lines.select(*place, "h1", "h2").join(first, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | ~same)
    return materialize(gone.groupBy("doc", "th").agg(F.collect_set("line").alias("gone")), "line-gone")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``_row`` (the columns of ``docs`` as a struct, ``text`` less its repeated lines), n_lines, n_removed.
    Documents without any are not shuffled with the others' lists, as far as hash slots can tell them apart."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(whole, id_col().alias("_doc"), F.xxhash64(text).alias("_th"))
    plain = docs.where(F.col(text).isNotNull()).select(id_col().alias("doc"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    gone = repeated_lines(plain, min_chars).select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("gone").alias("_gone"))
    slot = lambda: F.pmod(F.xxhash64("_doc", "_th"), F.lit(SLOTS)).alias("_slot")
    taken = gone.select(slot()).distinct()
    keyed = keyed.withColumn("_slot", slot())
    clean = keyed.join(F.broadcast(taken), "_slot", "left_anti").withColumn("_gone", F.lit(None).cast("array<int>"))
    other = keyed.join(F.broadcast(taken), "_slot", "left_semi").join(gone, ["_doc", "_th"], "left")
    # the text travels once, in the row
    cols = ["_row", F.col("_row").getField(text).cast("string").alias("_text"), "_gone"]
    both = clean.select(*cols).unionByName(other.select(*cols))
    kept = F.array_join(F.filter(F.split("_text", "\n", -1), lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    breaks = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"))) + 1
    return both.select(
        F.col("_row").withField(text, F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept)).alias("_row"),
        F.coalesce(breaks, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("_row.text", F.lit(""))
    return found.select(F.col("_row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
#: Edit distance of all lines against all is too slow in SQL on whole tables: tested against brute force.
ORACLE: dict[str, str] = {}
